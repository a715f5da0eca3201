"""Secret scans: fixed patterns, and strings that zstandard finds novel in a sensitive context.

A candidate is a long run of key-like characters, with letters and digits,
shortly after a sensitive word, on its line or beyond, or on the line after a
novel string. The text between the marks of a private key is one candidate. Its novelty is its
marginal cost: the bytes by which a zstandard frame of the surrounding text
grows when the candidate is added, for each of its characters. Its other
occurrences are taken out of that text, and all get the same verdict. The compressor
is primed with a dictionary of identifiers and common words, so that names,
paths and prose cost little where a random string costs nearly a byte a character.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelake.llm.common import session_of, small_batches, text_or_empty

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE_WORDS = ("passw", "passphrase", "secret", "token", "api", "credential", "auth", "bearer", "private", "access", "signature", "session")
SENSITIVE = re.compile(r"passw(?:or)?d|passphrase|secret|token|api[\x20_-]?key|credential|auth(?:orization)?|bearer|private[\x20_-]?key|access[\x20_-]?key|signature|session[\x20_-]?id", re.IGNORECASE | re.ASCII)
#: A run may begin after "=", which stands at its end only, as padding.
RUN = re.compile(r"[A-Za-z0-9+/_~.-]{16,}(?:={1,2}(?![A-Za-z0-9+/_~.-]))?", re.ASCII)
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_~.-]){RUN.pattern}", re.ASCII)
JOINTS = re.compile(r"[_.~-]*")
#: Where a value goes on after a line's end: quotes, commas, signs of continuation, and marks of comments.
NEXT_LINE = re.compile(r"""["'\\+,\x20\t\r]*+\n\s*+["'#>|*\x20]*+""")
#: The marks around a private key, and what stands in one whose end is missing.
PEM_BEGIN = re.compile(r"-{4,5}\x20?BEGIN [A-Z0-9\x20]*PRIVATE KEY(?: BLOCK)?\x20?-{4,5}")
PEM_END = re.compile(r"-{4,5}\x20?END ")
PEM_REST = re.compile(r"""(?:[A-Za-z0-9+/=\\"',]|\s)*+""", re.ASCII)
PEM_EDGES = " \t\r\n\\\"',"
LEAST_CORE, LEAST_RUN = 8, 16


class Context(NamedTuple):
    """What the novelty scan means by context: parameters of ``scan`` and ``redact``."""

    #: How far after a sensitive word a candidate may begin; a run of white space counts as one character.
    reach: int = 60
    #: How many characters on each side of a candidate stand in the frame with it.
    around: int = 256
    #: Bytes a character from which a candidate is novel. Random base64 costs about 0.9, identifiers below 0.6.
    novel: float = 0.7


@lru_cache
def _reached(reach: int) -> re.Pattern:
    return re.compile(rf"(?:\s++|\S){{0,{reach}}}+")


IDENTIFIERS = (
    "import from return class function def self this public private protected static const let var null None true false "
    "string number integer boolean object array list value index length count name type size data item node next previous parent child "
    "request response header content message error exception status code result config settings options parameter argument default "
    "username password passwd secret token api_key apikey access_key private_key client_id client_secret authorization bearer session_id signature credential "
    "http https localhost example com org net www index html json yaml xml csv txt log path file directory home user usr bin lib etc var tmp src main test build "
    "get set add remove update delete create insert select where order group limit offset connect open close read write start stop init "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 the and of to in is that for with as was on are be this have from or had by not but what all were when "
)


def _compressor():
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def core_of(found: str) -> str:
    """A candidate without the marks at its ends, by which its occurrences are known."""
    core = found.strip("+/_=~.-")
    return core if len(core) >= LEAST_CORE else found


def _around(text: str, start: int, end: int, around: int) -> str:
    """``around`` characters on both sides, without other occurrences of text[start:end], whole ones or such as the cut would part."""
    core = core_of(text[start:end])
    reach, edge = 2 * around + 4 * len(core), len(core) - 1
    left, right = text[max(0, start - reach) : start].replace(core, "\n"), text[end : end + reach].replace(core, "\n")
    left = left[edge:] if start > reach else left
    right = right[: max(0, len(right) - edge)] if end + reach < len(text) else right
    return left[len(left) - min(around, len(left)) :] + "\n" + right[:around]


def novelty(text: str, start: int, end: int, compressor, around: int = Context().around) -> float:
    """The marginal compressed bytes of text[start:end] for each of its bytes."""
    found = text[start:end].encode()
    beside = _around(text, start, end, around).encode()
    return (len(compressor.compress(beside + found)) - len(compressor.compress(beside))) / len(found)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's index, end, start of the secret itself) of the base patterns."""
    low = text.lower()
    spans = []
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, start: int, done: int, reach: int = Context().reach) -> Iterator[re.Match]:
    """The runs within reach of a sensitive word that ends at ``start``, from ``done`` on: what follows in the word's own run, then whole runs."""
    at = max(start, done)
    if at == start and (m := RUN.match(text, JOINTS.match(text, at).end())):
        yield m
        at = m.end()
    end = min(len(text), _reached(reach).match(text, start).end() + LEAST_RUN)
    while m := CANDIDATE.search(text, at, end):
        m = RUN.match(text, m.start())
        yield m
        at = m.end()


def private_keys(text: str) -> list[tuple[int, int]]:
    """Where the text between the marks of private keys stands; without an end mark, as far as it looks like one."""
    out = []
    begins = list(PEM_BEGIN.finditer(text)) if "PRIVATE KEY" in text else []
    for m, following in zip(begins, [*(b.start() for b in begins[1:]), len(text)]):
        end = PEM_END.search(text, m.end(), following)
        stop = end.start() if end else PEM_REST.match(text, m.end(), following).end()
        start = m.end()
        while start < stop and text[start] in PEM_EDGES or text.startswith(("\\n", "\\r"), start, stop):
            start += 2 if text[start] == "\\" and text[start + 1 : start + 2] in ("n", "r") else 1
        while start < stop and text[stop - 1] in PEM_EDGES or text.endswith(("\\n", "\\r"), start, stop):
            stop -= 2 if text.endswith(("\\n", "\\r"), start, stop) else 1
        if start < stop:
            out.append((start, stop))
    return out


def occurrences(text: str, cores: list[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of each core's occurrences, leftmost and without overlaps of one core, in one pass over the text."""
    import ahocorasick

    if not cores:
        return
    automaton, until = ahocorasick.Automaton(), {}
    for core in cores:
        automaton.add_word(core, core)
    automaton.make_automaton()
    for last, core in automaton.iter(text):
        start = last + 1 - len(core)
        if start >= until.get(core, 0):
            until[core] = last + 1
            yield start, last + 1


def novel_spans(text: str, base: list[tuple[int, int, int, int]], compressor, context: Context = Context()) -> list[tuple[int, int, int, int]]:
    """Incompressible strings that stand in a sensitive context, wherever they occur, where no base span touches them."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    done, verdicts, spans = 0, {}, {}

    def measured(start: int, end: int) -> bool:
        found = text[start:end]
        if not (re.search("[0-9]", found) and re.search("[A-Za-z]", found)):
            return False
        core = core_of(found)
        if core not in verdicts:
            verdicts[core] = novelty(text, start, end, compressor, context.around) >= context.novel
        if verdicts[core]:
            spans[start] = max(end, spans.get(start, 0))
        return verdicts[core]

    key_starts, key_ends = [], []
    for start, end in private_keys(text):
        runs = sum(m.end() - m.start() for m in RUN.finditer(text, start, end))
        if 2 * runs < end - start or novelty(text, start, end, compressor, context.around) < context.novel:
            for m in CANDIDATE.finditer(text, start, end):
                measured(m.start(), m.end())
            continue
        key_starts.append(start)
        key_ends.append(end)
        # Base spans inside part it.
        for s, _, e, _ in base:
            if start < e and s < end:
                if s > start:
                    spans[start] = s
                start = max(start, e)
        if start < end:
            spans[start] = end
    for word in SENSITIVE.finditer(text):
        for m in candidates(text, word.end(), done, context.reach):
            done = max(done, m.end())
            k = bisect_left(key_starts, m.end())
            if k and key_ends[k - 1] > m.start():
                continue
            while m and measured(m.start(), m.end()):
                m = (following := NEXT_LINE.match(text, m.end())) and RUN.match(text, following.end())
                done = max(done, m.end() if m else 0)
    for start, end in occurrences(text, [c for c, novel in verdicts.items() if novel]):
        spans[start] = max(end, spans.get(start, 0))
    starts, ends = [s for s, *_ in base], list(accumulate((e for _, _, e, _ in base), max))
    out, until = [], 0
    for start, end in sorted(spans.items()):
        before = bisect_left(starts, end)
        if before and ends[before - 1] > start:
            continue
        if start < until:  # occurrences that overlap are one span
            out[-1] = (out[-1][0], 3, max(until, end), out[-1][0])
        else:
            out.append((start, 3, end, start))
        until = max(until, end)
    return out


def scan_text(text: str, compressor, context: Context = Context()) -> list[tuple[int, int, int, int]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, compressor, context))


def listed(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def redact_text(text: str, spans: list[tuple[int, int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with the secrets themselves, not the names before them, replaced; overlapping ones by one mark."""
    out, at, open_end = [], 0, -1
    for start, end in sorted((v, e) for _, _, e, v in spans):
        if start < open_end:
            at = open_end = max(open_end, end)
            continue
        out += [text[at:start], mark]
        at = open_end = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, context: Context = Context()) -> DataFrame:
    """Every document's secrets: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Defined cases: a null text is empty and has no spans; overlapping spans of
    different kinds are all kept; repeated rows are scanned alike; an empty
    table gives an empty result; other columns are not passed on, and ids come
    back as they are, whatever other ids stand beside them.
    """
    small_batches(session_of(docs))

    def of_batches(batches: Iterator) -> Iterator:
        compressor = _compressor()
        for batch in batches:
            found = [scan_text(text, compressor, context) for text in batch.column("text").to_pylist()]
            kinds = [Counter(k for _, k, _, _ in spans) for spans in found]
            columns = {f"n_{name}": pa.array([c[k] for c in kinds], pa.int64()) for k, name in enumerate(KINDS)}
            hashes = [hashlib.sha256(listed([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns | {"base_sha256": pa.array(hashes, pa.string()), "spans": pa.array(map(listed, found), pa.string())})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(of_batches, schema)


def redact(docs: DataFrame, context: Context = Context()) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by a mark, and n_chars (if there) made to follow. Null texts stay null."""
    small_batches(session_of(docs))

    @F.arrow_udf("string")
    def clean_batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressor = _compressor()
        for batch in texts:
            yield pa.array([t if t is None else redact_text(t, s) if (s := scan_text(t, compressor, context)) else t for t in batch.to_pylist()], pa.string())
    out = docs.withColumn("text", clean_batches("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
