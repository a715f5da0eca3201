"""Store files: signed, compressed and encrypted segments."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelake.functions.crypto import Identity, file_key, sign, verify
from queuelake.model import COMPRESSION, ENCRYPTION
from queuelake.sources.wal import FormatError, WalHeader, decode_file, get_prefixed, put_prefixed

AUTH_SIZE = 152
ZSTD_LEVEL, ZSTD_WINDOW_LOG = 10, 27


@dataclass(frozen=True)
class StoreHeader:
    compression: int
    encryption: int
    entries_before: int
    num_entries: int

    def encode(self) -> bytes:
        return struct.pack("<3Q", 0, self.compression, self.encryption) + put_prefixed(self.entries_before) + put_prefixed(self.num_entries)

    @classmethod
    def decode(cls, data: bytes) -> tuple[StoreHeader, int]:
        if len(data) < 24:
            raise FormatError("too short")
        version, compression, encryption = struct.unpack_from("<3Q", data)
        if version or compression not in COMPRESSION.values() or encryption not in ENCRYPTION.values():
            raise FormatError("unsupported")
        before, at = get_prefixed(data, 24)
        count, at = get_prefixed(data, at)
        return cls(compression, encryption, before, count), at

    def id_range(self) -> tuple[int, int] | None:
        return (self.entries_before, self.entries_before + self.num_entries - 1) if self.num_entries else None


def encode_auth(header_signature: bytes, content_signature: bytes) -> bytes:
    return struct.pack("<2Q", 0, 0) + header_signature + struct.pack("<Q", 0) + content_signature


def decode_auth(data: bytes) -> tuple[bytes, bytes]:
    """The header's and the content's signatures."""
    if len(data) < AUTH_SIZE:
        raise FormatError("too short")
    version, kind = struct.unpack_from("<2Q", data)
    if version or kind or struct.unpack_from("<Q", data, 80)[0]:
        raise FormatError("unsupported")
    return data[16:80], data[88:152]


def compress(data: bytes, compression: int) -> bytes:
    if compression == COMPRESSION["NONE"]:
        return data
    if compression != COMPRESSION["ZSTD"]:
        raise FormatError("only zstd is written")
    import zstandard

    chosen = zstandard.ZstdCompressionParameters.from_level(ZSTD_LEVEL, window_log=ZSTD_WINDOW_LOG, enable_ldm=True)
    return zstandard.ZstdCompressor(compression_params=chosen).compress(data)


def decompress(data: bytes, compression: int) -> bytes:
    """The gzip tag stands for zstd, as such files hold zstd frames."""
    if compression == COMPRESSION["NONE"]:
        return data
    if compression == COMPRESSION["XZ"]:
        return lzma.decompress(data)
    import zstandard

    reader = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    return reader.decompress(data)


def encode(wal_files: DataFrame, identity: Identity, compression: int = COMPRESSION["ZSTD"], encryption: int = ENCRYPTION["AES"]) -> DataFrame:
    """(queue, file_id, content): store files made of WAL files (queue, file_id, content).

    Files without a valid entry give no store file. Each body is the whole WAL
    file, compressed; then encrypted by Spark itself with the file's own key and nonce.
    """
    seed, secret = identity.seed, identity.secret

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for queue, file_id, content in zip(batch["queue"], batch["file_id"], batch["content"]):
                content = bytes(content)
                header, entries = decode_file(content)
                if header is None or not entries:
                    continue
                key, nonce = file_key(seed, queue, file_id)
                head = StoreHeader(compression, encryption, header.entries_before, len(entries)).encode()
                out.append((queue, file_id, head, compress(content, compression), key, nonce))
            yield pd.DataFrame(out, columns=["queue", "file_id", "head", "body", "key", "nonce"])

    bodies = wal_files.select("queue", "file_id", "content").mapInPandas(body, "queue string, file_id long, head binary, body binary, key binary, nonce binary")
    if encryption == ENCRYPTION["AES"]:
        bodies = bodies.withColumn("body", F.aes_encrypt("body", "key", F.lit("GCM"), F.lit("DEFAULT"), "nonce"))

    @F.pandas_udf("binary")
    def file(heads: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([encode_auth(sign(secret, bytes(h)), sign(secret, bytes(b))) + bytes(h) + bytes(b) for h, b in zip(heads, bodies)], dtype=object)

    return bodies.select("queue", "file_id", file("head", "body").alias("content"))


def parse(store_files: DataFrame, identity: Identity, check: bool = True) -> DataFrame:
    """The files' parts: queue, file_id, compression, encryption, entries_before, num_entries, body, key, valid.

    ``valid`` is false where the bytes aren't the format or, if ``check``, a signature doesn't hold.
    """
    seed, public = identity.seed, identity.public

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for queue, file_id, content in zip(batch["queue"], batch["file_id"], batch["content"]):
                content = bytes(content)
                try:
                    signed_head, signed_body = decode_auth(content)
                    h, at = StoreHeader.decode(content[AUTH_SIZE:])
                except FormatError:
                    out.append((queue, file_id, None, None, None, None, None, None, False))
                    continue
                head, body = content[AUTH_SIZE : AUTH_SIZE + at], content[AUTH_SIZE + at :]
                good = not check or verify(public, head, signed_head) and verify(public, body, signed_body)
                out.append((queue, file_id, h.compression, h.encryption, h.entries_before, h.num_entries, body, file_key(seed, queue, file_id)[0], good))
            frame = pd.DataFrame(out, columns=["queue", "file_id", "compression", "encryption", "entries_before", "num_entries", "body", "key", "valid"])
            yield frame.astype({"compression": "Int32", "encryption": "Int32", "entries_before": "Int64", "num_entries": "Int64"})

    schema = "queue string, file_id long, compression int, encryption int, entries_before long, num_entries long, body binary, key binary, valid boolean"
    return store_files.select("queue", "file_id", "content").mapInPandas(of, schema)


def extract(store_files: DataFrame, identity: Identity, check: bool = True) -> DataFrame:
    """(queue, file_id, content): the WAL files inside; a file that fails a signature, decryption or decompression gives no row."""
    parts = parse(store_files, identity, check).where("valid")
    plain = F.try_aes_decrypt("body", "key", F.lit("GCM"))
    parts = parts.withColumn("body", F.when(F.col("encryption") == ENCRYPTION["AES"], plain).otherwise(F.col("body"))).where("body IS NOT NULL")

    @F.pandas_udf("binary")
    def unpack(bodies: pd.Series, kinds: pd.Series) -> pd.Series:
        def one(body: bytes, kind: int) -> bytes | None:
            try:
                return decompress(bytes(body), int(kind))
            except Exception as e:  # noqa: BLE001  zstandard and lzma have errors of their own
                if type(e).__name__ in ("ZstdError", "LZMAError", "EOFError"):
                    return None
                raise

        return pd.Series([one(b, k) for b, k in zip(bodies, kinds)], dtype=object)

    return parts.select("queue", "file_id", unpack("body", "compression").alias("content")).where("content IS NOT NULL")


def ranges(store_files: DataFrame, identity: Identity, check: bool = False) -> DataFrame:
    """(queue, file_id, first_id, last_id) from the headers alone; files without entries have no range."""
    parts = parse(store_files, identity, check).where("valid AND num_entries > 0")
    return parts.select("queue", "file_id", F.col("entries_before").alias("first_id"), (F.col("entries_before") + F.col("num_entries") - 1).alias("last_id"))


def wal_headers(store_files: DataFrame, identity: Identity) -> DataFrame:
    """The WAL headers inside store files."""
    from queuelake.sources.wal import headers

    return headers(extract(store_files, identity, check=False))


__all__ = ["StoreHeader", "WalHeader", "compress", "decode_auth", "decompress", "encode", "encode_auth", "extract", "parse", "ranges", "wal_headers"]
