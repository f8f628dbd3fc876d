"""Operator 12: token counts of whole texts, huge ones in overlapping chunks.

Texts of up to ``CHUNK`` characters are encoded whole.  A longer one is cut into chunks that
overlap, the chunks are dealt out over the cluster, and each is encoded with the offsets of
its tokens.  Two neighbours are spliced at a place in their overlap where both see a word
begin.  Such a place is proven stable: these tokenizers cut a text into words from left to
right, looking a few characters ahead and never back, and then encode each word by itself.
The left chunk's words are those of the whole text up to ``margin`` characters before its
end; a chunk that begins a word where the whole text does goes on as the whole text does.
Where an overlap holds no such place (one run without any word border), the overlaps of
that text are widened fourfold and it is encoded again, in the end as one chunk.

Where the tokenizer is known to end a word before each space between two visible ASCII
characters, whole texts are cut there first, and of the equal pieces of a slice of texts the
library encodes one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinio.llm import tokens as kernels
from opinio.llm.common import broadcast_if_small, column, settle

#: Characters of a chunk without its overlap, and of the first overlap.
CHUNK, OVERLAP = 1 << 15, 256
#: Characters given to the library at once, so that its results stay small.
SLICE_CHARS = 1 << 18
#: Bytes of whole texts whose pieces are put together.
SLICE_BYTES = 1 << 24
#: Largest tokenizer file that is broadcast.
MAX_FILE = 1 << 26

Word = tuple[int, int]  # where a word begins, tokens before it

VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = True


def pieces(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces of the texts ``raw[bounds[i]:bounds[i + 1]]`` begin: at each text, and at
    each space between two visible ASCII characters."""
    seen = VISIBLE[raw]
    spaces = np.flatnonzero((raw[1:-1] == 0x20) & seen[:-2] & seen[2:]) + 1
    first = np.unique(np.concatenate([bounds[:-1], spaces]))
    return first[first < len(raw)]


class JsonTokenizer:
    """A ``tokenizers`` file.  ``provable`` says whether its kind of splitting is known to
    look ahead only, so that texts may be spliced; others are encoded whole."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(data.decode("utf-8"))
        self.lib.no_truncation()
        self.lib.no_padding()
        about = json.loads(data)
        added = about["added_tokens"]
        parts = lambda x, many: [] if x is None else x.get(many, [x])
        normalizers = {x["type"] for x in parts(about["normalizer"], "normalizers")}
        splits = parts(about["pre_tokenizer"], "pretokenizers")
        ahead = all(x["type"] == "ByteLevel" and not x["add_prefix_space"]
                    or x["type"] == "Split" and "(?<" not in str(x["pattern"]) for x in splits)
        self.provable = bool(
            about["post_processor"] is None and about["model"]["type"] == "BPE" and splits and ahead
            and any(x["type"] == "Split" or x.get("use_regex") for x in splits)
            and normalizers <= {"NFC", "NFKC", "Lowercase", "Replace"}
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added))
        #: A normalizer may join a character with the next: then borders lie between ASCII characters.
        self.ascii_borders = bool(normalizers)
        self.margin = 16 + max((len(t["content"]) for t in added), default=0)
        # The words of this splitting hold no space but at their beginning, and where one begins
        # does not depend on what is before a space that follows a visible character.
        self.by_pieces = bool(
            self.provable and not normalizers and len(splits) == 1 and splits[0]["type"] == "ByteLevel"
            and not about["model"].get("dropout") and not any(" " in t["content"] for t in added))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, text: str) -> tuple[list[Word], int]:
        found = self.lib.encode(text, add_special_tokens=False)
        ids, offsets = found.word_ids, found.offsets
        first = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
        starts = [(offsets[i][0], i) for i in first]
        if self.ascii_borders:
            starts = [(p, i) for p, i in starts if text[p].isascii() and (not p or text[p - 1].isascii())]
        return starts, len(ids)


class PieceTokenizer:
    """A ``sentencepiece`` model.  Its pieces do not reach over a space between two other
    characters if none of the vocabulary holds one inside."""

    SPACE = "▁"
    margin = 16
    by_pieces = False

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.lib = SentencePieceProcessor(model_proto=data)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.provable = not any(self.SPACE in p.lstrip(self.SPACE) for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.lib.encode(texts, num_threads=1)]

    def words(self, text: str) -> tuple[list[Word], int]:
        plain = self.SPACE + text.replace(" ", self.SPACE)
        pieces = self.lib.encode(text, out_type=str, num_threads=1)
        if self.lib.normalize(text) != plain:  # the model rewrites this text: no border is proven
            return [], len(pieces)
        ids = self.lib.encode(text, num_threads=1)
        starts, at, run = [], -1, 0  # the first space is put before the text
        for i, (piece, number) in enumerate(zip(pieces, ids, strict=True)):
            if self.lib.is_byte(number):
                run += 1
                width = 0 if run % len(plain[at + 1].encode()) else 1
                run = 0 if width else run
            else:
                run, width = 0, len(piece)
            # A single space: the word after it is encoded as if it began the text.
            if piece[0] == self.SPACE and piece[1:2] not in ("", self.SPACE) and at > 0 and text[at - 1] != " ":
                starts.append((at + 1, i))
            at += width
        return starts, len(pieces)


def load(kind: str, data: bytes) -> JsonTokenizer | PieceTokenizer:
    return JsonTokenizer(data) if kind == "json" else PieceTokenizer(data)


_LOADED: dict[int, JsonTokenizer | PieceTokenizer] = {}


class _Task:
    """The tokenizer, built once per Python worker from the broadcast file."""

    def __init__(self, kind: str, data):
        self.kind, self.data = kind, data

    def tokenizer(self) -> JsonTokenizer | PieceTokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        key = hash((self.kind, self.data.value))
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = load(self.kind, self.data.value)
        return _LOADED[key]


def _in_slices(lib: JsonTokenizer | PieceTokenizer, texts: list[str]) -> np.ndarray:
    """Tokens of each text; the library gets some of them at once."""
    out, lo, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS:
            out += lib.counts(texts[lo:i + 1])
            lo, size = i + 1, 0
    return np.array([*out, *(lib.counts(texts[lo:]) if lo < len(texts) else ())], np.int64)


def whole_counts(lib: JsonTokenizer | PieceTokenizer, texts: pa.Array) -> np.ndarray:
    """Tokens of each text of a column without nulls."""
    if not lib.by_pieces:
        return _in_slices(lib, texts.to_pylist())
    raw, offsets = kernels.text_bytes(texts)
    out = np.zeros(len(texts), np.int64)
    for lo, hi in kernels.slices(offsets, SLICE_BYTES):
        own, bounds = raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        first = pieces(own, bounds)
        ends = np.append(first, len(own))
        cut = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(own)).dictionary_encode()
        n = _in_slices(lib, cut.dictionary.to_pylist())
        before = np.concatenate([[0], np.cumsum(n[cut.indices.to_numpy()])])
        out[lo:hi] = np.diff(before[np.searchsorted(first, bounds)])
    return out


class CountWhole(_Task):
    """Tokens of the texts that have no ``__key``; the others' numbers stay null."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = self.tokenizer()
        for batch in batches:
            whole = batch.column("__key").is_null()
            n = np.zeros(batch.num_rows, np.int64)
            chosen = whole.to_numpy(zero_copy_only=False)
            n[chosen] = whole_counts(lib, batch.column("__text").filter(whole))
            names = [c for c in batch.schema.names if c != "__text"]
            arrays = [pa.array(n, pa.int64(), mask=~chosen) if c == "n_tokens" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names)


class Cut(_Task):
    """Texts to chunks ``key, k, start, text`` of ``chunk`` characters and an overlap."""

    def __init__(self, kind: str, data, chunk: int, overlap: int):
        super().__init__(kind, data)
        self.chunk, self.overlap = chunk, overlap

    def __call__(self, batches):
        whole = not self.tokenizer().provable
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                step = len(text) if whole else self.chunk
                n = max(1, -(-(len(text) - self.overlap) // step))
                for k in range(n):
                    to = len(text) if k == n - 1 else (k + 1) * step + self.overlap
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array([key]), "k": pa.array([k], pa.int64()), "start": pa.array([k * step], pa.int64()),
                        "n": pa.array([n], pa.int64()), "text": pa.array([text[k * step:to]])})


_ZONE = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))


class Encode(_Task):
    """Chunks to their tokens and the word borders in the two overlaps."""

    def __init__(self, kind: str, data, overlap: int):
        super().__init__(kind, data)
        self.overlap = overlap

    def __call__(self, batches):
        lib = self.tokenizer()
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("key", "k", "start", "n")}
            total, head, tail = [], [], []
            for i, text in enumerate(batch.column("text")):
                text, k, start, n = text.as_py(), cols["k"][i], cols["start"][i], cols["n"][i]
                if n == 1:
                    total += lib.counts([text])
                    head.append([])
                    tail.append([])
                    continue
                words, tokens = lib.words(text)
                zone = lambda lo, hi: [{"at": start + p, "before": b} for p, b in words if lo <= p <= hi]  # noqa: B023, E731
                total.append(tokens)
                head.append(zone(0, self.overlap - lib.margin) if k else [])
                tail.append(zone(len(text) - self.overlap, len(text) - lib.margin) if k < n - 1 else [])
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(cols["key"]), "k": pa.array(cols["k"], pa.int64()), "n": pa.array(cols["n"], pa.int64()),
                "tokens": pa.array(total, pa.int64()), "head": pa.array(head, _ZONE), "tail": pa.array(tail, _ZONE)})


def _spliced(chunks: DataFrame) -> DataFrame:
    """``key, n_tokens``: sums over chunks between splices, null where a splice is missing."""
    places = lambda c: F.transform(c, lambda x: x["at"])
    before = lambda c, at: F.get(F.filter(c, lambda x: x["at"] == at), 0)["before"]
    following = F.lead("head").over(Window.partitionBy("key").orderBy("k"))
    seam = chunks.withColumn("following", following)
    seam = seam.withColumn("at", F.array_min(F.array_intersect(places("tail"), places("following"))))
    last = F.col("k") == F.col("n") - 1
    own = F.when(last, F.col("tokens")).otherwise(before(F.col("tail"), F.col("at")) - before(F.col("following"), F.col("at")))
    return (seam.select("key", own.alias("own")).groupBy("key")
            .agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens")))


def long_counts(texts: DataFrame, kind: str, data, chunk: int, overlap: int) -> DataFrame:
    """``key, n_tokens`` of the texts ``key, text`` by overlapping chunks, each text once."""
    todo, done = texts, None
    while True:
        cut = todo.mapInArrow(Cut(kind, data, chunk, overlap), "key string, k long, start long, n long, text string")
        # Equal texts have equal keys: copies fall together in the tasks, before the chunks are dealt out.
        once = cut.groupBy("key", "k").agg(*[F.any_value(c).alias(c) for c in ("start", "n", "text")])
        zone = "array<struct<at:long,before:long>>"
        read = once.mapInArrow(Encode(kind, data, overlap),
                               f"key string, k long, n long, tokens long, head {zone}, tail {zone}")
        counts = settle(_spliced(read))
        found = counts.where("n_tokens IS NOT NULL")
        done = found if done is None else done.unionByName(found)
        open_ = counts.where("n_tokens IS NULL").select("key")
        if open_.isEmpty():
            return done
        todo = texts.join(broadcast_if_small(open_, F.lit(80)), "key", "left_semi")
        overlap *= 4
        chunk = max(chunk, 4 * overlap)


def read_file(path: str) -> bytes:
    size = os.path.getsize(path)
    if size > MAX_FILE:
        raise ValueError(f"{path} has {size} bytes, more than the {MAX_FILE} that are broadcast")
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = (),
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns plus ``n_bytes`` (UTF-8) and ``n_tokens`` of each row's whole text.

    ``tokenizer`` is the path, on the driver, of a ``tokenizers`` file (``.json``) or a
    ``sentencepiece`` model (``.model``); its bytes are broadcast.  No begin, end or added
    tokens; special strings inside texts are handled as the library does by default.  Null
    and empty texts have no bytes and no tokens; rows without id or with a repeated id are
    rows like others, and equal texts have equal counts; ``n_bytes`` and ``n_tokens`` among
    ``keep`` are replaced; an empty table gives no rows.
    """
    kind = tokenizer.rpartition(".")[2]
    if kind not in ("json", "model"):
        raise ValueError(f"neither .json nor .model: {tokenizer}")
    data = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer))
    if overlap <= 2 * load(kind, data.value).margin:
        raise ValueError("the overlap must be more than twice the tokenizer's margin")
    kept = [c for c in keep if c not in ("n_bytes", "n_tokens")]
    text: Column = F.coalesce(column(docs, text_col), F.lit(""))
    long = F.length(text) > chunk
    slim = docs.select(*[column(docs, c).alias(c) for c in kept], F.octet_length(text).cast("long").alias("n_bytes"),
                       F.lit(None).cast("long").alias("n_tokens"), F.when(long, F.sha2(text, 256)).alias("__key"),
                       text.alias("__text"))
    counted = slim.mapInArrow(CountWhole(kind, data), slim.drop("__text").schema)
    texts = docs.where(long).select(F.sha2(text, 256).alias("key"), text.alias("text"))
    found = long_counts(texts, kind, data, chunk, overlap)
    found = broadcast_if_small(found.select(F.col("key").alias("__of"), F.col("n_tokens").alias("__n")), F.lit(96))
    whole = counted.join(found, F.col("__key") == F.col("__of"), "left")
    total = F.coalesce("n_tokens", "__n")
    return whole.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept], "n_bytes", total.alias("n_tokens"))
