"""Numbers, names, keys and file formats against golden values and plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from queuelake.functions import crypto, naming, uintn
from queuelake.model import COMPRESSION, ENCRYPTION, width_of
from queuelake.sources import store, wal

#: Ids and their paths.
PATHS = {0: "000", 1: "001", 15: "00f", 16: "010", 255: "0ff", 256: "100", 4095: "fff", 4096: "001/000", 65535: "00f/fff", 65536: "010/000", 1048575: "0ff/fff", 16777215: "fff/fff", 16777216: "001/000/000", 4294967295: "0ff/fff/fff", 4294967296: "100/000/000"}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_paths(spark):
    rows = spark.createDataFrame([(i,) for i in PATHS], "i long").select("i", uintn.path_of(F.col("i")).alias("p"), uintn.path_to_id(uintn.file_path("", F.col("i"), "wal")).alias("back")).collect()
    assert all(r["p"] == PATHS[r["i"]] and r["back"] == r["i"] for r in rows)
    wide = spark.createDataFrame([(str(2**64 - 1),), (str(2**127),)], "a string").select(uintn.path_big("a").alias("p")).collect()
    assert wide[0]["p"] == "00f/fff/fff/fff/fff/fff" and wide[1]["p"].replace("/", "").lstrip("0") == f"{2**127:x}"
    assert one(spark, uintn.path_to_id(F.lit("zz.wal")).alias("x"))["x"] is None
    assert max(r["back"] for r in rows if PATHS[r["i"]] in ("fff/fff", "001/000/000")) == 16777216


def test_widths_and_arithmetic(spark):
    assert [width_of(n) for n in (0, 255, 256, 65535, 65536, 2**32, 2**64, 2**128 - 1, 2**128)] == [1, 1, 2, 2, 4, 8, 16, 16, 17]
    big = 2**62
    r = one(spark, uintn.middle(F.lit(big), F.lit(big + 3)).alias("m"), uintn.width(F.lit(big)).alias("w"), uintn.can_fit(F.lit(256), 1).alias("f"), uintn.decrement(F.lit(5)).alias("d"), uintn.from_hex(F.lit("1000")).alias("h"), uintn.parse_decimal(F.lit("12a")).alias("p"), uintn.display_client(F.lit(200)).alias("s"))
    assert (r["m"], r["w"], r["f"], r["d"], r["h"], r["p"], r["s"]) == (big + 1, 8, False, 4, 4096, None, "c8")
    for bad in (uintn.decrement(F.lit(0)), uintn.sub(F.lit(1), F.lit(2)), uintn.rem(F.lit(1), F.lit(0)), uintn.checked(F.lit(256), 1)):
        with pytest.raises(Exception, match="unsigned|remainder|fit"):
            one(spark, bad)
    assert [one(spark, uintn.progress(F.lit(c), F.lit(10), F.lit(20)).alias("p"))["p"] for c in (5, 10, 15, 20, 30)] == [0.0, 0.0, 0.5, 1.0, 1.0]
    assert [r["i"] for r in spark.range(20).where(uintn.in_step(F.col("id"), 3, 0)).select(F.col("id").alias("i")).collect()] == list(range(3, 20))


def test_any_width_functions(spark):
    rng = random.Random(1)
    pairs = [(rng.getrandbits(rng.choice((1, 8, 31, 64, 127, 200))), rng.getrandbits(rng.choice((1, 8, 64, 128)))) for _ in range(60)] + [(2**128 - 11, 20)]
    rows = spark.createDataFrame([(str(max(p)), str(min(p))) for p in pairs], "a string, b string").select(
        "a", "b", uintn.add_big("a", "b").alias("s"), uintn.sub_big("a", "b").alias("d"), uintn.middle_big("a", "b").alias("m"), uintn.width_big("a").alias("w"), uintn.key_big("a").alias("k"),
        uintn.from_le_bytes(uintn.to_le_bytes("a")).alias("le"), uintn.from_prefixed(uintn.to_prefixed("a")).alias("pre"), uintn.from_be_bytes(F.lit(b"\x01\x00")).alias("be"), uintn.from_hex_big(F.lit("fff")).alias("hex"), uintn.to_le_bytes_of(32)("b").alias("fixed"),
    ).collect()
    for r in rows:
        a, b = int(r["a"]), int(r["b"])
        assert (int(r["s"]), int(r["d"]), int(r["m"]), r["w"]) == (a + b, a - b, (a + b) // 2, width_of(a))
        assert r["le"] == r["pre"] == r["a"] and r["be"] == "256" and r["hex"] == "4095" and bytes(r["fixed"]) == b.to_bytes(32, "little")
    assert [r["a"] for r in sorted(rows, key=lambda r: r["k"])] == [r["a"] for r in sorted(rows, key=lambda r: int(r["a"]))]


def test_names(spark):
    r = one(spark, naming.resolve(F.lit("my_queue"), "abc123def456").alias("a"), naming.resolve(F.lit("/shared/queue"), "x").alias("b"), naming.resolve(F.lit("a/b"), "x").alias("c"), naming.cloud_key("p/", F.lit("/i/q"), F.lit(4096)).alias("k"), naming.wal_path("/d", F.lit("/i/q"), F.lit(1)).alias("w"), naming.cloud_queue_path("p/", F.lit("/i/q")).alias("q"))
    assert tuple(r) == ("/abc123def456/my_queue", "/shared/queue", "/x/a/b", "p/i/q/001/000.store", "/d/i/q/wal/001.wal", "p/i/q/")
    import re

    for glob, name, ok in (("/a/*", "/a/b/c", True), ("/a/?", "/a/b", True), ("/a/?", "/a/bc", False), ("{x,y}*", "yes", True), ("[a-c]1", "b1", True), ("[!a]1", "a1", False), ("**/q", "a/b/q", True), ("**/q", "q", True), ("a.b", "axb", False)):
        assert bool(re.match(naming.glob_regex(glob), name)) == ok, (glob, name)


def test_crypto_vectors():
    """Published vectors: RFC 5869 test 3, ChaCha20 with a zero key, RFC 8032 tests 1 to 3."""
    assert crypto.hkdf_sha256(b"\x0b" * 22, b"", 42).hex() == "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"
    assert crypto.chacha20_stream(bytes(32), 64).hex() == "76b8e0ada0f13d90405d6ae55386bd28bdd219b8a08ded1aa836efcc8b770dc7da41597c5157488d7724e03fb8d84a376a43b8f41518a11cc387b669b2ee6586"
    for secret, public, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        secret, public, message, signature = map(bytes.fromhex, (secret, public, message, signature))
        assert crypto.public_key(secret) == public and crypto.sign(secret, message) == signature and crypto.verify(public, message, signature)
        assert not crypto.verify(public, message + b"x", signature) and not crypto.verify(public, message, signature[:-1] + b"\xff")


def test_identity(tmp_path):
    import os
    import stat

    one, two = crypto.Identity.open(str(tmp_path)), crypto.Identity.open(str(tmp_path))
    assert one.instance_id == two.instance_id == hashlib.sha256(one.public).hexdigest() and len(one.instance_id) == 64
    assert stat.S_IMODE(os.stat(tmp_path / crypto.SEED_FILE).st_mode) == 0o600
    assert crypto.file_key(one.seed, "/q", 1) == crypto.file_key(one.seed, "/q", 1) != crypto.file_key(one.seed, "/q", 2)
    with pytest.raises(ValueError):
        crypto.Identity(b"short")


def test_wal_bytes():
    """A header and an entry of the format."""
    assert wal.WalHeader(2, 4, 123).encode() == bytes.fromhex("0000000000000000 0200000000000000 0400000000000000 0100000000000000 7b")
    longer = bytes.fromhex("0000000000000000 0200000000000000 0400000000000000 0800000000000000 7b00000000000000")
    assert wal.WalHeader.decode(longer) == (wal.WalHeader(2, 4, 123), 40)
    entry = wal.encode_entry(wal.WalHeader(2, 4, 0), 456, b"hello world")
    assert entry == bytes(8) + bytes.fromhex("c8010000 0b00 68691eb23467ab45") + b"hello world"
    import xxhash

    assert xxhash.xxh64_intdigest(b"hello world", 0) == 5020219685658847592 and xxhash.xxh64_intdigest(b"", 0) == 0xEF46DB3751D8E999
    for bad in (b"", b"\x01\x02\x03", bytes.fromhex("FFAABBCCDDEEFF001122"), bytes.fromhex("BAD0DADA"), b"\x01" + bytes(40)):
        assert wal.decode_file(bad) == (None, [])


def damaged():
    header = wal.WalHeader()
    records = [(i, f"record {i}".encode()) for i in range(1, 6)]
    three, four = wal.encode_file(header, records[:3]), wal.encode_entry(header, 4, b"record 4")
    flipped = bytearray(wal.encode_file(header, records))
    flipped[-1] ^= 1
    return [("whole", wal.encode_file(header, records), 5), ("noise", three + random.Random(1).randbytes(50), 3), ("cropped", three + four[: len(four) // 2], 3), ("garbage", three + b"\xff" * 100, 3), ("flipped", bytes(flipped), 4), ("short", wal.encode_file(header, records)[:-10], 4), ("header", header.encode(), 0), ("empty", b"", 0), ("bad", b"\x01\x02\x03", 0)]


def test_valid_prefixes(spark):
    files = spark.createDataFrame([(name, 1, bytearray(data)) for name, data, _ in damaged()], "queue string, file_id long, content binary")
    got = {r["queue"]: r for r in wal.index(files).collect()}
    states = {"header": "HEADER_ONLY", "empty": "EMPTY", "bad": "CORRUPT"}
    for name, data, n in damaged():
        r = got[name]
        assert (r["num_entries"], r["first_id"], r["last_id"], r["state"], r["bytes"]) == (n, 1 if n else None, n if n else None, states.get(name, "VALID"), len(data))
    assert wal.decode(files).count() == sum(n for _, _, n in damaged())
    assert sorted(r["id"] for r in wal.read_range(files.where("queue = 'whole'"), 1, 5, 2).collect()) == [1, 3, 5]
    assert wal.headers(files).count() == len(damaged()) - 2


def test_files_on_disk_and_the_data_source(spark, tmp_path):
    from queuelake.sources import datasource
    from queuelake.sources.objects import ObjectStore

    rows = [("/i/q", f, i, bytearray(f"entry-{i}".encode())) for i in range(25) for f in [i // 10 + 1]] + [("/i/other", 1, 0, bytearray(b"x"))]
    entries = spark.createDataFrame(rows, "queue string, file_id long, id long, data binary")
    objects = ObjectStore(spark, str(tmp_path / "root"))
    named = wal.encode(entries).withColumn("key", F.substring(naming.wal_path("", F.col("queue"), F.col("file_id")), 2, 1000))
    assert objects.write_files(named).count() == 4
    files = wal.read_files(spark, str(tmp_path / "root"))
    assert sorted(r["file_id"] for r in wal.closed_files(files.where("queue = '/i/q'"), 3).collect()) == [1, 2]
    assert sorted((r["queue"], r["id"], bytes(r["data"])) for r in wal.decode(files).collect()) == sorted((q, i, bytes(d)) for q, _, i, d in rows)
    assert sorted(r["key"] for r in objects.files("wal").collect()) == ["i/other/wal/001.wal", "i/q/wal/001.wal", "i/q/wal/002.wal", "i/q/wal/003.wal"]
    datasource.register(spark)
    table = spark.read.format("queue_wal").load(str(tmp_path / "root"))
    assert sorted(r["id"] for r in table.where("queue = '/i/q' AND id >= 8 AND id <= 12").collect()) == [8, 9, 10, 11, 12]
    assert table.count() == 26 and table.where("queue = '/none'").count() == 0
    part = spark.read.format("queue_wal").option("queue", "/i/q").option("start", 8).option("end", 12).load(str(tmp_path / "root"))
    assert sorted(r["id"] for r in part.collect()) == [8, 9, 10, 11, 12]
    assert [p.file_id for p in datasource.WalReader(str(tmp_path / "root"), "/i/q", 10, None).partitions()] == [2, 3]
    assert spark.read.format("queue_wal").option("queue", "/none").load(str(tmp_path / "root")).count() == 0


def test_objects(spark, tmp_path):
    from queuelake.sources.objects import ObjectStore

    objects = ObjectStore(spark, str(tmp_path))
    objects.put("a/b/one.store", b"0123456789")
    objects.put("a/two.store", b"")
    assert (objects.head("a/b/one.store"), objects.head("none"), objects.get("none")) == (10, None, None)
    assert (objects.get("a/b/one.store"), objects.get_range("a/b/one.store", 2, 4), objects.get_range("a/b/one.store", 8, None), objects.get("a/two.store")) == (b"0123456789", b"234", b"89", b"")
    assert [n for n in objects.list("a")[0] if not n.endswith(".crc")] == ["a/two.store"] and objects.list("a")[1] == ["a/b/"] and objects.list("zzz") == ([], [])
    objects.put("a/b/one.store", b"new")
    assert objects.get("a/b/one.store") == b"new" and objects.delete("a/b/one.store") and objects.head("a/b/one.store") is None


def test_store_headers():
    h = store.StoreHeader(COMPRESSION["ZSTD"], ENCRYPTION["AES"], 10, 20)
    assert store.StoreHeader.decode(h.encode()) == (h, len(h.encode())) and h.id_range() == (10, 29)
    assert store.StoreHeader(0, 0, 10, 0).id_range() is None
    for bad in (b"", h.encode()[:30], b"\x09" + h.encode()[1:], h.encode()[:8] + b"\x09" + h.encode()[9:]):
        with pytest.raises(wal.FormatError):
            store.StoreHeader.decode(bad)
    auth = store.encode_auth(b"h" * 64, b"c" * 64)
    assert len(auth) == store.AUTH_SIZE and store.decode_auth(auth) == (b"h" * 64, b"c" * 64)


@pytest.mark.parametrize("compression", ["NONE", "ZSTD"])
@pytest.mark.parametrize("encryption", ["NONE", "AES"])
def test_store_files(spark, compression, encryption):
    identity = crypto.Identity(bytes(32))
    content = wal.encode_file(wal.WalHeader(entries_before=7), [(i, b"payload" * i) for i in range(7, 40)])
    files = spark.createDataFrame([("/q", 3, bytearray(content)), ("/q", 4, bytearray(wal.WalHeader().encode()))], "queue string, file_id long, content binary")
    made = store.encode(files, identity, COMPRESSION[compression], ENCRYPTION[encryption]).collect()
    assert len(made) == 1
    data = bytes(made[0]["content"])
    back = lambda d, who=identity, check=True: store.extract(spark.createDataFrame([("/q", 3, bytearray(d))], "queue string, file_id long, content binary"), who, check).collect()
    assert bytes(back(data)[0]["content"]) == content
    assert tuple(store.ranges(spark.createDataFrame([("/q", 3, bytearray(data))], "queue string, file_id long, content binary"), identity).first()) == ("/q", 3, 7, 39)
    for place in (store.AUTH_SIZE + 25, len(data) - 3, 20):
        broken = bytearray(data)
        broken[place] ^= 1
        assert back(broken) == []
    assert back(data, crypto.Identity(b"\x01" * 32)) == []
    if encryption == "AES":
        key, nonce = crypto.file_key(identity.seed, "/q", 3)
        at = store.AUTH_SIZE + store.StoreHeader.decode(data[store.AUTH_SIZE :])[1]
        assert data[at : at + 12] == nonce


def test_old_compression_tags():
    import lzma

    import zstandard

    assert store.decompress(zstandard.compress(b"x" * 100), COMPRESSION["GZIP"]) == b"x" * 100
    assert store.decompress(lzma.compress(b"y" * 100), COMPRESSION["XZ"]) == b"y" * 100
    for kind in ("GZIP", "XZ"):
        with pytest.raises(wal.FormatError):
            store.compress(b"", COMPRESSION[kind])
