"""Secret scan: fixed patterns, then candidates confirmed by decoding their structure.

A base64 or hex candidate is reported only if its decoded bytes parse: nested lengths of
a key encoding (a SEQUENCE whose parts fill it exactly), the JSON header of a signed
token, or text in which a fixed pattern matches again, however often it was encoded. Runs
wrapped over lines are joined first.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lineage import small_batches
from tidemark.llm.wordcache import tidy

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "key", "signed", "nested")
LEAST_VALUE, LEAST_ACCESS = 8, 16
#: The least bytes that parse: "token=" with a value (access keys and nested lengths take 16, signed
#: headers 18), their base64 characters before padding, and the least signed token, {"alg":""} with a body.
LEAST_BYTES = len("token=") + LEAST_VALUE
LEAST_BASE64 = -(-LEAST_BYTES * 8 // 6)
LEAST_SIGNED = 14 + len(".") + 2 + len(".")
#: The least run without white space that may hold any of them.
LEAST_RUN = min(2 * LEAST_BYTES, LEAST_BASE64, LEAST_SIGNED)
BASE64_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_BASE64},}}={{0,2}}")
ANY_HEX = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{{2 * LEAST_BYTES},}}")
#: Lines that hold one run each; the first may follow other text and the last may be padded.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++(?=={0,2}[ \t]*(?:\r?\n|\Z)))+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s]*)-----END \1-----")
SIGNED = re.compile(r"(?<![\w-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)", re.ASCII)
Span = tuple[int, int, int]


def base_spans(text: str, long_run: bool = True) -> list[Span]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if long_run:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


#: Tags of the parts that key encodings are made of; those with 0x20 hold other parts.
TAGS = frozenset({0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x30, 0x31, 0xA0, 0xA1})
#: The least bytes of a key encoding.
LEAST_KEY = 16


def nested_lengths(data: bytes) -> bool:
    """Whether the bytes are one SEQUENCE whose parts fill it, down to its leaves, however deep."""
    at, ends = 0, [len(data)]
    if len(data) < LEAST_KEY or data[0] != 0x30:
        return False
    while at < len(data):
        stop = ends[-1]
        if at + 2 > stop:
            return False
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > stop:
                return False
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if tag not in TAGS or at + size > stop or size == 0 and (tag == 0x02 or tag & 0x20):
            return False
        if tag & 0x20:
            ends.append(at + size)
        else:
            at += size
        while len(ends) > 1 and at == ends[-1]:
            ends.pop()
        # The outermost part is the only one of its level.
        if len(ends) == 1 and at < len(data):
            return False
    return len(ends) == 1


def from_base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_header(part: str) -> bool:
    try:
        head = json.loads(from_base64(part) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def decoded(run: str) -> Iterator[bytes]:
    """What a run may stand for: base64 from each of the four places of a group, hex from each of two.

    A run that other letters of its alphabet precede, as ``path/`` does, has its groups at one
    of these places.
    """
    if ANY_HEX.fullmatch(run):
        yield from (bytes.fromhex(run[i : len(run) - (len(run) - i) % 2]) for i in (0, 1))
    body = run.rstrip("=")
    for i in range(4):
        # A single letter left over is no byte.
        if data := from_base64(body[i : len(body) - ((len(body) - i) % 4 == 1)]):
            yield data


def key_after_slash(run: str) -> bool:
    """Whether what follows one of the run's slashes is a key encoding."""
    body = run.rstrip("=")
    for m in re.finditer("/(?=M[A-P])", body):
        # The header tells the length, so only a run that ends where the key does is decoded.
        head = (from_base64(body[m.end() : m.end() + 8]) or b"").ljust(2, b"\0")
        size, rest = head[1], (len(body) - m.end()) * 3 // 4
        n = size & 0x7F if size & 0x80 else 0
        size = int.from_bytes(head[2 : 2 + n], "big") if n else size
        if n <= 4 and size + 2 + n == rest and nested_lengths(from_base64(body[m.end() :]) or b""):
            return True
    return False


def meaning(run: str) -> int | None:
    """The kind that a run confirms, or None: decoded until a structure or nothing new comes out."""
    whole = from_base64(run)
    if whole and nested_lengths(whole) or "/" in run and key_after_slash(run):
        return 3
    left, seen = [run], {run}
    while left:
        for data in decoded(left.pop()):
            if data[0] == 0x30 and nested_lengths(data):
                return 3
            # The patterns are ASCII, so lines, other letters and bytes that are no text around them do not matter;
            # without its zeros text of two bytes a letter reads as any other.
            for form in {data, data.replace(b"\0", b"")}:
                inner = form.decode("utf-8", "replace")
                if base_spans(inner) or any(signed_header(m[1]) for m in SIGNED.finditer(inner)) or "-----BEGIN " in inner and armoured_spans(inner):
                    return 5
                # What is inside is shorter, so this ends.
                more = {r for _, _, r in wrapped_runs(inner)} | {m[0] for m in BASE64_RUN.finditer(inner)}
                left += more - seen
                seen |= more
    return None


def wrapped_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, joined run) of runs that go over lines of one width and a shorter last one.

    A first line that follows other text may be shorter, or a word; the last line may be a word
    too, so both readings come. At least one line is long enough for a run by itself.
    """
    for m in WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in LINE.finditer(text, m.start(), m.end())]
        size = [e - s for s, e in lines]
        at = 0
        while at + 1 < len(lines):
            width, last = max(size[at : at + 2]), at if size[at] > size[at + 1] else at + 1
            while last + 1 < len(lines) and size[last + 1] == width:
                last += 1
            stops = {last, last + 1} if last + 1 < len(lines) and size[last + 1] < width else {last}
            firsts = {at}
            if size[at] < width:
                alone = at > 0 or not text[text.rfind("\n", 0, lines[0][0]) + 1 : lines[0][0]].strip(" \t")
                firsts = {at + 1} if alone else {at, at + 1}
            if width >= LEAST_RUN:
                for first in firsts:
                    for stop in stops:
                        if stop > first:
                            yield lines[first][0], lines[stop][1], "".join(text[s:e] for s, e in lines[first : stop + 1])
            at = last + 1


def confirmed_spans(text: str) -> list[Span]:
    """(start, kind, end) of candidates whose structure has been decoded."""
    found, blocks = [], []
    for m in SIGNED.finditer(text):
        if signed_header(m[1]):
            found.append((m.start(), 4, m.end()))
    if "\n" in text:
        for start, end, run in wrapped_runs(text):
            if (kind := meaning(run)) is not None:
                blocks.append((start, kind, end))
    # Of readings that overlap the longest stands; its lines are no candidates of their own.
    free = 0
    for start, kind, end in sorted(blocks, key=lambda b: (b[0], -b[2])):
        if start >= free:
            found.append((start, kind, end))
            free = end
    inside = [(s, e) for s, _, e in found if "\n" in text[s:e]]
    for pattern in (ANY_HEX, BASE64_RUN):
        at = 0
        for m in pattern.finditer(text):
            while at < len(inside) and inside[at][1] <= m.start():
                at += 1
            if at < len(inside) and inside[at][0] <= m.start():
                continue
            if (kind := meaning(m[0])) is not None:
                found.append((m.start(), kind, m.end()))
    return found


def armoured_spans(text: str) -> list[Span]:
    found = []
    for m in ARMOUR.finditer(text):
        data = from_base64("".join(m[2].split()))
        if data and (nested_lengths(data) or "OPENSSH" in m[1] and data.startswith(b"openssh-key-v1\0")):
            found.append((m.start(), 3, m.end()))
    return found


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans in order of start, then kind."""
    # No hex or base64 run holds white space, so a text of short words needs no search for them.
    long_run = any(len(w) >= LEAST_RUN for w in text.split())
    base = base_spans(text, long_run)
    more = confirmed_spans(text) if long_run else []
    if "-----BEGIN " in text:
        more += armoured_spans(text)
    return base, sorted({*base, *more}) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[Span], mask: str) -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, their digest and all spans.

    Null and empty texts have no spans, and an empty table gives no rows. A very long text is
    scanned whole, in one piece, in time linear in its length but for the runs it nests.
    Repeated rows give repeated rows; other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = scan(text or "")
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            cols = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
    return made.withColumnRenamed("id", id_col)


def mask_secrets(docs: DataFrame, mask: str = "[secret]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, every reported span replaced; clean texts stay as they are.

    Null and empty texts have no spans, repeated rows stay repeated and other columns pass
    untouched, whatever their names. A masked text gets its new length in ``length_col`` if
    there is such a column; a text that was not changed keeps the length it came with.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = {i: masked(t, spans, mask) for i, t in enumerate(texts) if t and (spans := scan(t)[1])}
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                if length_at is not None:
                    lengths = batch.column(length_at).to_pylist()
                    columns[length_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(lengths)], batch.schema.field(length_at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
