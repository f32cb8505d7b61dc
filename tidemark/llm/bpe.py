"""Byte-level BPE as a monoid: halves are encoded alone and joined at their border.

``encode(a + b) = join(encode(a), encode(b))``. A join recomputes a window around the
border and widens it until what lies outside is proven final:

* between matches of the split pattern, a match that ended before its half's last run of
  characters cannot change, and matching has met the right half again once a new match
  ends where one of the right half's matches ended;
* inside one match, a token sequence is the encoding of its bytes exactly if each two
  neighbours encode to themselves, so the two pairs at the window's edges decide.

Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.lineage import small_batches
from tidemark.llm.wordcache import Recent, held, tidy

LEAF_CHARS = 1 << 14
LEAF_BYTES = 24
CACHE_PIECES = 300_000
#: White space as Unicode lists it, spelt out as libraries differ on the control characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NEVER = 1 << 60
#: Texts below this character are split by the standard library, which is twice as fast.
NEAR = 0x250


def compile_near(pattern: str) -> re.Pattern | None:
    """The split pattern for texts below NEAR, if it names no classes but letters, numbers and white space."""

    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(NEAR) if unicodedata.category(chr(c))[0] == kind)

    spelt = pattern.replace("\\p{L}", "L{").replace("\\p{N}", "N{")
    if "\\p" in spelt or "\\P" in spelt:
        return None
    inside, out = False, []
    for part in re.findall(r"[LN]\{|\\.|.", spelt):
        inside = part == "[" or inside and part != "]"
        text = {"L{": members("L"), "N{": members("N"), "\\s": SPACE}.get(part)
        if part == "\\S":
            out.append(f"[^{SPACE}]")
        else:
            out.append(part if text is None else text if inside else f"[{text}]")
    return re.compile("".join(out))


def compile_split(pattern: str) -> regex.Pattern:
    """The vocabulary's split pattern with its white space classes spelt out."""
    spelt, inside = [], False
    for part in regex.findall(r"\\.|.", pattern):
        inside = part == "[" or inside and part != "]"
        spelt.append({"\\s": SPACE if inside else f"[{SPACE}]", "\\S": f"[^{SPACE}]"}.get(part, part))
    return regex.compile("".join(spelt))


class ByteBpe:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.split, self.leaf_chars, self.leaf_bytes = compile_split(pattern), leaf_chars, leaf_bytes
        self.near, self.far = compile_near(pattern), re.compile(f"[^\\x00-{chr(NEAR - 1)}]")
        self.by_text = {str(i): b for b, i in ranks.items()}
        self.cache = Recent(self.piece, CACHE_PIECES)
        self.back = Recent(self.bytes_of_code, CACHE_PIECES, 256)
        self.stable: dict[tuple[int, int], bool] = {}

    # -- inside one match -------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        if len(data) > 64:
            return self._merge_long(data)
        rank_of = ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank_of(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < NEVER:
            i = pairs.index(least)
            new = parts[i] + parts[i + 1]
            parts[i : i + 2] = [new]
            del pairs[i]
            if i:
                pairs[i - 1] = rank_of(parts[i - 1] + new, NEVER)
            if i < len(pairs):
                pairs[i] = rank_of(new + parts[i + 1], NEVER)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same by a heap, for windows that have grown."""
        n, ranks = len(data), self.ranks
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = 0, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def pair_stands(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens encode to themselves."""
        key = (left, right)
        if (known := self.stable.get(key)) is None:
            if len(self.stable) >= CACHE_PIECES:
                self.stable.clear()
            known = self.stable[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b:
            return a + b
        if self.pair_stands(a[-1], b[0]):
            return a + b
        wide = 1
        while True:
            left, right = a[-wide:], b[:wide]
            mid = self.merge(b"".join(map(self.bytes_of.__getitem__, left + right)))
            rest_a, rest_b = a[: len(a) - len(left)], b[len(right) :]
            if (not rest_a or self.pair_stands(rest_a[-1], mid[0])) and (not rest_b or self.pair_stands(mid[-1], rest_b[0])):
                return rest_a + mid + rest_b
            wide *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        half = len(data) // 2
        return self.join_tokens(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, text: str) -> str:
        """One match's ids in decimal, joined by commas."""
        data = text.encode()
        whole = self.ranks.get(data)
        return str(whole) if whole is not None else ",".join(map(str, self.tree(data)))

    # -- over a whole text ------------------------------------------------
    def matches(self, text: str) -> list[str]:
        if self.near is not None and (text.isascii() or not self.far.search(text)):
            return self.near.findall(text)
        return self.split.findall(text)

    def codes(self, pieces: list[str]) -> list[str]:
        return self.cache.all(pieces)

    def encode(self, text: str) -> tuple[list[str], list[str]]:
        """The matches of a text and their ids, from its halves."""
        if len(text) <= self.leaf_chars:
            pieces = self.matches(text)
            return pieces, self.codes(pieces)
        half = len(text) // 2
        return self.join(self.encode(text[:half]), self.encode(text[half:]))

    def join(self, a: tuple[list[str], list[str]], b: tuple[list[str], list[str]]) -> tuple[list[str], list[str]]:
        keep, wide = len(a[0]), 0
        # The last match may go on in the right half, and white space before it looks one character ahead.
        while keep and wide < 2:
            keep, wide = keep - 1, wide + 1
        take = 1
        while True:
            window = "".join(a[0][keep:] + b[0][:take])
            border = len(window) - sum(map(len, b[0][:take]))
            ends, at = set(), border
            for p in b[0][:take]:
                at += len(p)
                ends.add(at)
            pieces, at, met = [], 0, take >= len(b[0])
            for p in self.matches(window):
                pieces.append(p)
                at += len(p)
                # A match that ends before the window's last one was decided by text that is in the window.
                if not met and at in ends and at < len(window) - len(b[0][take - 1]):
                    met = True
                    break
            if met:
                used, n = border, 0
                while used < at:
                    used += len(b[0][n])
                    n += 1
                return a[0][:keep] + pieces + b[0][n:], a[1][:keep] + self.codes(pieces) + b[1][n:]
            take = take * 2 + 1

    def bytes_of_code(self, code: str) -> bytes:
        """The bytes of the ids of one match."""
        return b"".join(map(self.by_text.__getitem__, code.split(",")))

    def decode(self, codes: list[str]) -> bytes:
        """The bytes of runs of ids in decimal, joined up the tree."""
        if len(codes) <= self.leaf_chars:
            return b"".join(self.back.all(codes))
        half = len(codes) // 2
        return self.decode(codes[:half]) + self.decode(codes[half:])

    def digest(self, text: str) -> tuple[int, str, str]:
        codes = self.encode(text)[1]
        joined = ",".join(codes)
        n = joined.count(",") + 1 if joined else 0
        return n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(codes)).hexdigest()


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def load_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(name: str, raw: bytes, pattern: str) -> ByteBpe:
    """One encoder for each vocabulary and Python worker, so that its cache lives on."""
    return held(name, lambda: ByteBpe(read_ranks(raw), pattern))


def encode_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every whole text; null texts count as empty."""
    small_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, raw.value, pattern)
        for batch in batches:
            ids = [[int(i) for c in bpe.encode(t or "")[1] for i in c.split(",")] for t in batch.column(1).to_pylist()]
            back = [bpe.decode([*map(str, x)]) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run, path), f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: token count and digests of its ids and of the decoded bytes.

    Null and empty texts give 0 tokens and the digest of nothing. Repeated rows give
    repeated rows. Other columns are not read, so clashing names cannot matter.
    """
    small_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, raw.value, pattern)
        for batch in batches:
            rows = [bpe.digest(t or "") for t in batch.column(1).to_pylist()]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        tidy(run, path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return made.withColumnRenamed("id", id_col)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
