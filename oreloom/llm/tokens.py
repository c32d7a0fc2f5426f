"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

The most frequent words of the corpus are compiled with their ids into a minimal acyclic transducer: a
shared-suffix automaton whose transitions carry counts, so that walking a word yields its number and thereby
its ids. Executors memory-map it. Each batch walks its distinct words through the automaton at once (numpy);
words that it lacks are merged exactly by byte-pair rank.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.session import cut, ensure_checkpoint_dir, spread

#: The vocabulary file; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern that belongs to the tokenizer; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words compiled into the automaton; bounds what the driver collects (about 1 MB).
LEXICON_WORDS = 40_000
#: Text per step inside a batch, which bounds the memory of a Python worker.
SLICE_BYTES = 4_000_000
#: Merged pre-tokens a worker remembers.
CACHE_WORDS = 200_000

_WS = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A blank that is inside a run of white space but neither its first nor a last one before a word; no cut is possible there.
_UNCUTTABLE = rf"{_WS} {_WS}|{_WS} $"


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    """Token bytes -> id from a rank file (base64, blank, id per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by exact byte-pair merging, lowest rank first, leftmost among equals; O(n log n)."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = nxt[i]
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            r = ranks.get(piece[i : end[nxt[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0:
            p = prv[i]
            r = ranks.get(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class WordCoder:
    """Exact ids of any string: cut into pre-tokens, look up or merge each. Used for words the lexicon lacks."""

    def __init__(self, path: str = TOKENIZER) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.cut = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for piece in self.cut(text):
            ids = cache.get(piece)
            if ids is None:
                ids = merge(piece.encode(), self.ranks)
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                if len(piece) <= 64:
                    cache[piece] = ids
            out += ids
        return out


def build_transducer(words: Iterable[bytes], outputs: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of the words as flat arrays.

    key[i] = state * 256 + byte of the sorted transitions, goal[i] its target, skip[i] the number of words that
    precede those behind it, final[state]; ids/start hold the outputs by word number.
    """
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []

    def freeze(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        if shape not in register:
            register[shape] = len(frozen)
            frozen.append(shape)
        return register[shape]

    path: list[list] = [[False, []]]
    before = b""
    for word in words:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        for k in range(len(before), common, -1):
            node = path.pop()
            path[-1][1].append((before[k - 1], freeze(node)))
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        before = word
    for k in range(len(before), 0, -1):
        node = path.pop()
        path[-1][1].append((before[k - 1], freeze(node)))
    root = freeze(path[0])
    size = [0] * len(frozen)
    for s, (final, moves) in enumerate(frozen):  # targets are frozen before their sources
        size[s] = int(final) + sum(size[t] for _, t in moves)
    key, goal, skip = [], [], []
    for s, (final, moves) in enumerate(frozen):
        seen = int(final)
        for byte, t in moves:
            key.append(s * 256 + byte)
            goal.append(t)
            skip.append(seen)
            seen += size[t]
    flat = [i for w in words for i in outputs[w]]
    start = np.concatenate([[0], np.cumsum([len(outputs[w]) for w in words])])
    return {
        "key": np.array(key, np.int64),
        "goal": np.array(goal, np.int64),
        "skip": np.array(skip, np.int64),
        "final": np.array([f for f, _ in frozen], np.int64),
        "root": np.array([root], np.int64),
        "ids": np.array(flat, np.int64),
        "start": start.astype(np.int64),
    }


_PARTS = ("key", "goal", "skip", "final", "root", "ids", "start")


def pack(parts: dict[str, np.ndarray]) -> bytes:
    """One file: the lengths of the seven arrays, then the arrays, all int64."""
    arrays = [parts[p] for p in _PARTS]
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def open_mapped(path: str) -> dict[str, np.ndarray]:
    """Memory-map a packed transducer; the workers of a machine share its pages."""
    whole = np.memmap(path, np.int64, mode="r")
    out, at = {}, len(_PARTS)
    for name, n in zip(_PARTS, whole[: len(_PARTS)], strict=True):
        out[name] = whole[at : at + int(n)]
        at += int(n)
    return out


def look_up(parts: dict[str, np.ndarray], strings: pa.Array) -> np.ndarray:
    """Word number of each string or -1, walking all strings through the automaton byte by byte at once."""
    data = strings.cast(pa.large_binary())
    n = len(data)
    found = np.full(n, -1, np.int64)
    if n == 0 or len(parts["key"]) == 0:
        return found
    bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + n + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    begin, length = bounds[:-1], np.diff(bounds)
    key, goal, skip, final = parts["key"], parts["goal"], parts["skip"], parts["final"]
    live = np.arange(n)
    state = np.full(n, int(parts["root"][0]), np.int64)
    number = np.zeros(n, np.int64)
    depth = 0
    while len(live):
        ended = length[live] == depth
        if ended.any():
            done = live[ended]
            ok = final[state[done]] == 1
            found[done[ok]] = number[done[ok]]
            live = live[~ended]
            if not len(live):
                break
        want = state[live] * 256 + raw[begin[live] + depth]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[at] == want
        live, at = live[hit], at[hit]
        state[live] = goal[at]
        number[live] += skip[at]
        depth += 1
    return found


def _with_blank(words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type))


class CorpusCoder:
    """Encodes Arrow batches of texts with the mapped lexicon and the exact coder for the rest."""

    def __init__(self, lexicon: dict[str, np.ndarray], tokenizer: str = TOKENIZER) -> None:
        self.lexicon = lexicon
        self.exact = WordCoder(tokenizer)

    def _resolve(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of each distinct string."""
        number = look_up(self.lexicon, strings)
        ids, start = self.lexicon["ids"], self.lexicon["start"]
        known = number >= 0
        at = np.zeros(len(strings), np.int64)
        size = np.zeros(len(strings), np.int64)
        at[known] = start[number[known]]
        size[known] = start[number[known] + 1] - at[known]
        extra: list[int] = []
        missing = np.flatnonzero(~known)
        for i, text in zip(missing, strings.take(pa.array(missing)).to_pylist(), strict=True):
            new = self.exact.encode(text)
            at[i], size[i] = len(ids) + len(extra), len(new)
            extra += new
        return np.concatenate([ids, np.array(extra, np.int64)]), at, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string array; null and empty texts get none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        hard = pc.match_substring_regex(texts, _UNCUTTABLE)
        easy = pc.if_else(hard, "", texts)
        words = pc.split_pattern(easy, " ")
        offsets = np.asarray(words.offsets)
        flat = words.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        bounds = offsets - offsets[0]
        coded = flat.dictionary_encode()
        index = np.array(coded.indices, np.int64)
        later = _with_blank(coded.dictionary)  # all but the first word of a text bear their blank
        firsts = flat.take(pa.array(bounds[:-1])).dictionary_encode()
        distinct = pa.concat_arrays([later.cast(pa.large_string()), firsts.dictionary.cast(pa.large_string())])
        index[bounds[:-1]] = len(later) + np.asarray(firsts.indices)
        ids, at, size = self._resolve(distinct)
        sizes = size[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        total = int(ends[-1])
        place = np.repeat(at[index] - ends[:-1], sizes) + np.arange(total)
        out = ids[place]
        starts = ends[bounds]
        rows = np.flatnonzero(np.asarray(hard.to_numpy(zero_copy_only=False), bool))
        if not len(rows):
            return out, starts
        pieces, lengths = [], np.diff(starts)
        done = 0
        for row in rows:
            pieces.append(out[starts[done] : starts[row]])
            own = np.array(self.exact.encode(texts[int(row)].as_py()), np.int64)
            pieces.append(own)
            lengths[row] = len(own)
            done = row + 1
        pieces.append(out[starts[done] : starts[-1]])
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(lengths)])


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of about SLICE_BYTES; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - 1).clip(0) // SLICE_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(size)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(a), int(b - a)


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """word (with its leading blank), n over all texts; batches are counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(0), "")
            for first, count in slices(column):
                words = pc.split_pattern(column.slice(first, count), " ").flatten()
                found = words.value_counts()
                names = _with_blank(found.field(0))
                yield pa.RecordBatch.from_arrays([names, found.field(1)], names=["word", "n"])

    return (
        spread(documents.select(text))
        .mapInArrow(run, "word string, n bigint")
        .filter(F.length("word") <= 40)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def most_frequent(counts: DataFrame, n_words: int) -> list:
    """At most n_words rows of the most frequent words: all whose count reaches a floor found from a small histogram.

    Unlike a top-k, no task sends more than its share of the result to the driver.
    """
    counts = cut(counts.withColumn("step", F.floor(F.log("n") * 50)))
    floor, taken = None, 0
    for row in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # a few hundred steps at any size
        taken += row["count"]
        if taken > n_words:
            break
        floor = row["step"]
    return [] if floor is None else counts.filter(F.col("step") >= floor).select("word").collect()


def compile_lexicon(documents: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, n_words: int = LEXICON_WORDS) -> str:
    """Compile the n_words most frequent words of all texts and ship the packed automaton; returns its file name.

    The file is written to the shared folder that the session names and fetched by each executor.
    """
    spark: SparkSession = documents.sparkSession
    top = most_frequent(word_counts(documents, text), n_words)
    coder = WordCoder(tokenizer)
    outputs = {r.word.encode(): coder.encode(r.word) for r in top}
    blob = pack(build_transducer(outputs, outputs))
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/{name}")
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(blob))
    stream.close()
    sc.addFile(path.toString())
    return name


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, count_only: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """key and ids array<int> of each text (or n_tokens int if count_only); columns in ``carry`` pass through.

    Null and empty texts give the empty list; strings of special tokens are ordinary text; texts of any
    length are encoded whole. One pass builds the lexicon, one encodes; nothing but word counts is shuffled.
    """
    lexicon = compile_lexicon(documents, text, tokenizer)
    passed = [documents.schema[c] for c in (key, *carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or CorpusCoder(open_mapped(SparkFiles.get(lexicon)), tokenizer)
            column = batch.column(batch.num_columns - 1)
            for first, count in slices(column):
                ids, starts = coder.encode(column.slice(first, count))
                kept = [batch.column(i).slice(first, count) for i in range(len(passed))]
                if count_only:
                    made = pa.array(np.diff(starts).astype(np.int32))
                else:
                    made = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*kept, made], names=[*[f.name for f in passed], "n_tokens" if count_only else "ids"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed)
    return spread(documents.select(key, *carry, text)).mapInArrow(run, f"{types}, {'n_tokens int' if count_only else 'ids array<int>'}")
