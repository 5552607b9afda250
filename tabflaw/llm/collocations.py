"""Phrase collocations by SON partitioning.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and line breaks,
and pieces into words at blanks and tabs.  Per language, a phrase of 2 to
MOST_WORDS words is a collocation if it occurs ``support`` times or more.

1. *Blocks*: texts are dealt by language into groups of about SHARD_WORDS words,
   and their words become numbers, in blocks of up to BLOCK_WORDS words of one
   language with their vocabulary.  What one task then reads of a language is a
   shard.  Summed word counts give the words that reach the support.
2. *Local mining*, one phrase length after another: every shard is mined
   completely at the support lowered to its share of the language, which a
   phrase must reach in some shard to reach the support in sum.  Only phrases
   whose shorter parts are still candidates are looked at, and of them those
   whose slot reaches the support in a table of hashed counts over all blocks.
3. *Union*: local counts are added up.  In a shard that does not name it, a
   phrase stays below the local support, so the sum plus that much is a bound;
   phrases whose bound reaches the support are the candidates.
4. *Exact counts*: a last reading of all blocks counts every candidate.

What tasks must know of words and candidates goes to them as a Bloom filter of
at most FILTER_BITS bits, so its size has a bound whatever the corpus; what it
lets through by mistake is dropped by the exact sums.  Mining shuffles 64-bit
hashes and counts (a shared hash only adds a candidate); the last reading knows
phrases inside a block by dense numbers and sums by text, so it is exact.  Tasks
read blocks one after another, as many tasks as the cluster has cores, and add
up counts before they give them out: a phrase is given out once a task, however
much each reads, until a task finds more than HELD_HASHES (mining) or HELD_TEXTS
(last reading) phrases; a shard ends there too.  A hot language is many shards;
texts are shuffled once.

Scores compare a phrase with its cuts into a first and a second part; products
are decimals of 38 digits.  A longer candidate with ``inside_percent`` of a
phrase's occurrences absorbs it.

Defined results: a null or empty text has no words; a null language is ``und``
(and joins a language of that name); an empty table gives no rows.  Equal
scores are ordered by occurrences, then by the phrase's bytes.  Rows that
repeat count as often as they stand.  Texts of any length are read whole.
Columns other than the two named are ignored.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cells import row_index
from .common import one_long, written

SUPPORT = 100
MOST_WORDS = 5
TOP = 2000
INSIDE_PERCENT = 100
#: Words of a block: what a task sorts at once (some 50 bytes a word).
BLOCK_WORDS = 1 << 18
#: Words of a language that are dealt to one task.
SHARD_WORDS = 1 << 23
ROWS_A_BATCH = "4"
BLOCKS_A_FILE = 4                 # so that tasks can share a language's blocks evenly
#: Phrases with counts that a task holds before it gives them out: hashes in mining, texts in the last reading.
HELD_HASHES = 1 << 20
HELD_TEXTS = 1 << 19
_CHARS = 6                        # characters a word, about; for the layout only
#: Largest Bloom filter: 16 MB.
FILTER_BITS = 1 << 27
#: Most slots of a table of hashed counts: a byte each at a support below 256.
SLOTS = 1 << 26
_WORDS_A_SLOT = 8
_CHUNK = 1 << 16
UND = "und"
_END = "\n"                       # ends a piece; no word holds it
_BLANK = pa.scalar(" ", pa.large_string())
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _MIX) ^ b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    mask, high = np.uint64(bits - 1), h >> np.uint64(32)
    return h & mask, high * np.uint64(0x85EBCA6B) & mask, (h * _MIX >> np.uint64(24)) & mask


def _slot(h: np.ndarray, slots: int) -> tuple[np.ndarray]:
    return ((h >> np.uint64(24)) & np.uint64(slots - 1),)


class Filter:
    """Bits that 64-bit hashes must find set: a Bloom filter of three probes, or slots; ``bits`` is a power of two."""

    def __init__(self, bits: int, table: np.ndarray, probes: Callable = _probes):
        self.bits, self.table, self.probes = bits, table, probes

    def __call__(self, h: np.ndarray) -> np.ndarray:
        one = np.uint8(1)
        found = np.ones(len(h), bool)
        for p in self.probes(h, self.bits):
            found &= (self.table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & one == one
        return found


def bloom_filter(hashes: DataFrame, limit: int = FILTER_BITS) -> Filter:
    """Filter of the column ``h`` (bigint): 32 bits a row, as far as ``limit`` bits; merged by a sum of bits per byte."""
    n = one_long(hashes, F.count("*"))
    bits = min(limit, 1 << max(16, (32 * n - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(np.concatenate(_probes(h, bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(3)).astype(np.int64)),
                                              pa.array(1 << (at & np.uint64(7)).astype(np.int32))], names=["at", "bit"])

    rows = hashes.select("h").mapInArrow(places, "at bigint, bit int").groupBy("at").agg(F.bit_or("bit").alias("byte")).toArrow()
    table = np.zeros(bits >> 3, np.uint8)              # at most limit / 8 rows come to the driver
    table[rows.column("at").to_numpy()] = rows.column("byte").to_numpy().astype(np.uint8)
    return Filter(bits, table)


def _tokens(texts: pa.Array) -> pa.Array:
    """Words of all texts in one array, every piece ended by a line break (dictionary-encoded, with empty strings)."""
    cut = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[.,;:!?\x0A-\x0D]", " \n ")
    return pc.split_pattern_regex(pc.binary_join_element_wise(cut, "\n", " "), "[ \t]+").flatten().dictionary_encode()


class Block:
    """Words of one language as numbers; number 0 ends a piece."""

    def __init__(self, lang: str):
        self.lang, self.seed = lang, xxhash.xxh64_intdigest(lang)
        self.number: dict[str, int] = {_END: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: pa.Array) -> None:
        encoded = _tokens(texts)
        own = np.array([self.number.setdefault(w, len(self.number)) if w else -1 for w in encoded.dictionary.to_pylist()], np.int32)
        ids = own[encoded.indices.to_numpy()]
        ids = ids[ids >= 0]
        self.parts.append(ids)
        self.size += int(np.count_nonzero(ids))

    def words(self) -> pa.Array:
        return pa.array(list(self.number), pa.large_string())

    def hashes(self) -> np.ndarray:
        """One per word, the language included."""
        return np.array([xxhash.xxh64_intdigest(w, self.seed & 0xFFFFFFFF) for w in self.number], np.uint64)


def phrases(ids: np.ndarray, vocabulary: pa.Array, own: np.ndarray, keep: Callable[[np.ndarray, int], np.ndarray],
            most: int) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """Phrases of 2 to ``most`` words whose hashes and parts' hashes ``keep`` accepts: (texts, counts, number of words)."""
    size = len(vocabulary)
    good = keep(own, 1)
    good[0] = False
    number = np.where(good, np.cumsum(good) - 1, -1).astype(np.int32)
    at, texts, place = number[ids], vocabulary.filter(pa.array(good)), np.flatnonzero(good[ids]).astype(np.int32)
    hashes = own[ids[place]]
    for k in range(2, most + 1):
        go_on = np.zeros(len(place), bool)               # the parts without the first and without the last word are kept
        go_on[:-1] = place[1:] == place[:-1] + 1
        place, hashes = place[go_on], hashes[go_on]
        hashes = _mix(hashes, own[ids[place + (k - 1)]])
        good = keep(hashes, k)
        place, hashes = place[good], hashes[good]
        if not len(place):
            return
        distinct, which, counts = np.unique(at[place].astype(np.int64) * size + ids[place + (k - 1)], return_inverse=True, return_counts=True)
        at[place] = which
        texts = pc.binary_join_element_wise(texts.take(pa.array(distinct // size)), vocabulary.take(pa.array(distinct % size)), _BLANK)
        yield texts, counts, k


def _filled(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Block]:
    """Blocks of a task's batches (lang, text); the largest is given out whenever ``limit`` words are held."""
    held: dict[str, Block] = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        which = langs.indices.to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            held.setdefault(lang, Block(lang)).add(batch.column(1).take(pa.array(np.flatnonzero(which == k))))
            while sum(s.size for s in held.values()) >= limit:
                yield held.pop(max(held, key=lambda x: held[x].size))
    yield from held.values()


def encode(docs: DataFrame, text: str = "text", lang: str = "lang", block: int = BLOCK_WORDS, shard: int = SHARD_WORDS) -> DataFrame:
    """Blocks (lang, size, words, hashes, counts, ids): a vocabulary with counts, and the numbers of the words in their order.

    Texts are dealt by language and a running number into groups of about ``shard`` words, a task reading whole groups.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _filled(batches, block):
            if held.size:
                ids = np.concatenate(held.parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([held.lang]), pa.array([held.size]), pa.array([list(held.number)], pa.list_(pa.string())),
                     pa.array([held.hashes().view(np.int64)]), pa.array([np.bincount(ids, minlength=len(held.number))]),
                     pa.array([ids.tobytes()])], names=["lang", "size", "words", "hashes", "counts", "ids"])
        pa.default_memory_pool().release_unused()

    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UND)).alias("lang"), F.col(text).alias("text"))
    lengths = written(texts.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")), "colloc-lengths")      # a row per language
    groups = F.greatest(F.ceil(F.coalesce("chars", F.lit(0)) / (shard * _CHARS)), F.lit(1)).cast("bigint")
    dealt = texts.withColumn("at", F.monotonically_increasing_id()).join(lengths, "lang") \
        .withColumn("group", F.pmod(F.xxhash64("at"), groups)).select("lang", "group", "text").repartition("lang", "group").drop("group")
    return dealt.mapInArrow(run, "lang string, size bigint, words array<string>, hashes array<bigint>, counts array<bigint>, ids binary")


def _numbers(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


_SLICE = 100_000


def _sliced(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=_SLICE)


_FIELDS = ["lang", "phrase", "k", "f"]


def _summed(tables: list[pa.Table]) -> pa.Table:
    """Counts ``f`` of tables (lang, phrase, k, f), added up."""
    return pa.concat_tables(tables).group_by(_FIELDS[:3]).aggregate([("f", "sum")]).select([*_FIELDS[:3], "f_sum"]).rename_columns(_FIELDS)


def _added(tables: Iterator[pa.Table], limit: int) -> Iterator[pa.RecordBatch]:
    """The counts of a task, added up as far as ``limit`` phrases can be held."""
    held, size = [], 0
    for t in tables:
        held.append(t)
        size += len(t)
        if size >= limit:
            held = [_summed(held)]
            size = len(held[0])
            if size >= limit // 2:
                yield from held.pop().to_batches(max_chunksize=_SLICE)
                size = 0
    if held:
        yield from _summed(held).to_batches(max_chunksize=_SLICE)
    held.clear()
    pa.default_memory_pool().release_unused()       # the worker goes on to other tasks


def _counted(lang: str, texts: pa.Array, k: int, counts: np.ndarray) -> pa.Table:
    n = len(texts)
    return pa.table([pa.array([lang] * n, pa.string()), texts.cast(pa.string()), pa.array(np.full(n, k, np.int32)),
                     pa.array(counts.astype(np.int64))], names=_FIELDS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    for batch in batches:
        for row in range(len(batch)):
            yield batch, row


def word_counts(blocks: DataFrame) -> DataFrame:
    """(lang, phrase, h, f) of every word."""
    return blocks.select("lang", F.explode(F.arrays_zip("words", "hashes", "counts")).alias("w")).filter(F.col("w.words") != _END) \
        .groupBy("lang", F.col("w.words").alias("phrase"), F.col("w.hashes").alias("h")).agg(F.sum("w.counts").alias("f"))


def _placed(ids: np.ndarray, own: np.ndarray, parts: Filter, k: int) -> np.ndarray:
    """Hashes of a block's phrases of ``k`` words whose parts pass the filter, in their order."""
    h, whole = own[ids], ids != 0
    for step in range(1, k - 1):                                # parts of k - 1 words
        h, whole = _mix(h[:-1], own[ids[step:]]), whole[:-1] & (ids[step:] != 0)
    good = whole & parts(h)
    place = np.flatnonzero(good[:-1] & good[1:])
    return _mix(h[place], own[ids[place + (k - 1)]])


def _shared(blocks: DataFrame) -> DataFrame:
    """Blocks in as many partitions as the cluster has cores."""
    return blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Blocks with the numbers and hashes of their words."""
    for b, r in _blocks(batches):
        yield b, r, np.frombuffer(b.column("ids")[r].as_buffer(), np.int32), _numbers(b, r, "hashes").view(np.uint64)


def hashed_counts(blocks: DataFrame, parts: Filter, k: int, support: int, slots: int = SLOTS) -> Filter:
    """Slots that reach the support when all phrases of ``k`` words whose parts pass the filter are counted in a table by their hash."""
    width, chunk = np.min_scalar_type(support), min(slots, _CHUNK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots, width)
        for _, _, ids, own in _read(batches):
            at, counts = np.unique(_slot(_placed(ids, own, parts, k), slots)[0], return_counts=True)
            table[at] = np.minimum(table[at] + counts, support)         # more is not asked
        for at in range(0, slots, chunk):
            if (part := table[at:at + chunk]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at // chunk], pa.int32()), pa.array([part.tobytes()])], names=["at", "counts"])

    def reached(t: pa.Table) -> pa.Table:
        total = np.zeros(chunk, np.int64)
        for counts in t.column("counts"):
            total += np.frombuffer(counts.as_buffer(), width)
        return pa.table([t.column("at").slice(0, 1), pa.array([np.packbits(total >= support, bitorder="little").tobytes()])], names=["at", "bits"])

    rows = _shared(blocks.select("hashes", "ids")).mapInArrow(count, "at int, counts binary") \
        .groupBy("at").applyInArrow(reached, "at int, bits binary").toArrow()
    table = np.zeros((slots // chunk, chunk >> 3), np.uint8)               # slots / 8 bytes come to the driver
    for at, bits in zip(rows.column("at").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        table[at] = np.frombuffer(bits, np.uint8)
    return Filter(slots, table.reshape(-1), _slot)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashes (hashes, counts), added up."""
    hashes, which = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    counts = np.zeros(len(hashes), np.int64)
    np.add.at(counts, which, np.concatenate([c for _, c in parts]))
    return hashes, counts


def local_mining(blocks: DataFrame, parts: Filter, slots: Filter, k: int, support: int, limit: int = HELD_HASHES) -> DataFrame:
    """(number, h, above) of phrases of ``k`` words in blocks (number, n, size, hashes, ids) that pass ``slots`` and whose parts pass the filter.

    ``number`` is the language's and ``n`` its words.  ``above`` is by how much
    a phrase's local counts reach beyond the local supports less 1 of the
    shards that name it; where ``h`` is null, the sum of those of all shards.
    A shard ends where a task holds ``limit`` phrases.
    """
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        words: dict[int, int] = {}
        total: dict[int, int] = {}

        def size() -> int:
            return sum(len(h) for found in held.values() for h, _ in found)

        def give(lang: int) -> Iterator[pa.RecordBatch]:
            least = -(-support * words.pop(lang) // total[lang])
            h, counts = _merged(held.pop(lang))
            h, counts = h[counts >= least], counts[counts >= least]
            yield from _sliced([pa.array(np.full(len(h), lang, np.int32)), pa.array(h.view(np.int64)),
                                pa.array(counts - (least - 1))], ["number", "h", "above"])
            yield from _sliced([pa.array([lang], pa.int32()), pa.array([None], pa.int64()), pa.array([least - 1], pa.int64())], ["number", "h", "above"])

        for b, r, ids, own in _read(batches):
            lang = b.column("number")[r].as_py()
            total[lang] = b.column("n")[r].as_py()
            words[lang] = words.get(lang, 0) + b.column("size")[r].as_py()
            h = _placed(ids, own, parts, k)
            held.setdefault(lang, []).append(np.unique(h[slots(h)], return_counts=True))
            if size() >= limit:
                for x in held:
                    held[x] = [_merged(held[x])]
                while held and size() >= limit // 2:
                    yield from give(max(held, key=lambda x: len(held[x][0][0])))
        for lang in list(held):
            yield from give(lang)
        pa.default_memory_pool().release_unused()

    return _shared(blocks.select("number", "n", "size", "hashes", "ids")).mapInArrow(mine, "number int, h bigint, above bigint") \
        .groupBy("number", "h").agg(F.sum("above").alias("above"))


def exact_counts(blocks: DataFrame, filters: dict[int, Filter], limit: int = HELD_TEXTS) -> DataFrame:
    """(lang, phrase, k, f) over all blocks, of every phrase that the filters let through."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.Table]:
            for b, r, ids, own in _read(batches):
                words = b.column("words")[r].values.cast(pa.large_string())
                for texts, counts, k in phrases(ids, words, own, lambda h, k: filters[k](h), max(filters)):
                    yield _counted(b.column("lang")[r].as_py(), texts, k, counts)

        yield from _added(found(), limit)

    return _shared(blocks.select("lang", "words", "hashes", "ids")).mapInArrow(count, "lang string, phrase string, k int, f bigint") \
        .groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


@contextlib.contextmanager
def _few_rows_a_batch(spark: SparkSession) -> Iterator[None]:
    """Blocks are rows of a megabyte and more: within this, table scans take ROWS_A_BATCH rows at once, not thousands."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, ROWS_A_BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, most: int = MOST_WORDS,
                     block: int = BLOCK_WORDS, shard: int = SHARD_WORDS, hashes: int = HELD_HASHES, texts: int = HELD_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to ``most`` words with f >= support, and (lang, n) of the languages.

    A task holds at most ``hashes`` phrases in mining and ``texts`` in the last reading, and what one block adds.
    """
    blocks = written(encode(docs, text, lang, block, shard), "colloc-blocks", maxRecordsPerFile=BLOCKS_A_FILE)
    sizes = written(row_index(blocks.groupBy("lang").agg(F.sum("size").alias("n")), order_by="lang", name="number")
                    .withColumn("number", F.col("number").cast("int")), "colloc-sizes")
    dealt = blocks.join(sizes, "lang")                  # a written table of one row per language
    slots = min(SLOTS, 1 << max(16, (one_long(sizes, F.sum("n")) // _WORDS_A_SLOT).bit_length()))
    with _few_rows_a_batch(docs.sparkSession):
        words = written(word_counts(dealt).filter(F.col("f") >= support), "colloc-words")
        filters = {1: bloom_filter(words)}
        for k in range(2, most + 1):
            often = hashed_counts(dealt, filters[k - 1], k, support, slots)
            found = written(local_mining(dealt, filters[k - 1], often, k, support, hashes), f"colloc-mined{k}")
            slack = found.filter("h is null").select("number", F.col("above").alias("slack"))            # a row per language
            filters[k] = bloom_filter(found.filter("h is not null").join(slack, "number").filter(F.col("above") + F.col("slack") >= support))
        counted = written(exact_counts(dealt, filters, texts).filter(F.col("f") >= support), "colloc-counts")
    return words.select("lang", "phrase", F.lit(1).alias("k"), "f").unionByName(counted), sizes.select("lang", "n")


def cut_scores(frequent: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of every phrase of two words or more, by its lowest-scoring cut."""
    word = F.split("phrase", " ")
    cuts = frequent.filter("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))) \
        .select("lang", "phrase", "k", F.col("f").alias("a"), "cut", F.array_join(F.slice(word, F.lit(1), F.col("cut")), " ").alias("left"),
                F.array_join(F.slice(word, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    part = frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf"))
    both = cuts.join(part.withColumnsRenamed({"part": "left", "pf": "l"}), ["lang", "left"]) \
        .join(part.withColumnsRenamed({"part": "right", "pf": "r"}), ["lang", "right"]).join(sizes, "lang")
    wide = {c: f"cast({c} as decimal(19,0))" for c in ("a", "l", "r", "n")}
    score = F.expr(f"({wide['a']} * {wide['n']} * 1000) div ({wide['l']} * {wide['r']})")
    return both.withColumn("score", score) \
        .groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")) \
        .select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score")


def absorbed(frequent: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, phrase) of the phrases inside a longer candidate that has ``percent`` of their occurrences."""
    word = F.split("phrase", " ")
    inside = frequent.filter("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))) \
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1))) \
        .select("lang", F.array_join(F.slice(word, F.col("at"), F.col("size")), " ").alias("phrase"), F.col("f").alias("longer")) \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return inside.join(frequent.select("lang", "phrase", "f"), ["lang", "phrase"]) \
        .filter(F.col("longer") * 100 >= F.col("f") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, most: int = MOST_WORDS,
                 top: int = TOP, inside_percent: int = INSIDE_PERCENT, block: int = BLOCK_WORDS, shard: int = SHARD_WORDS,
                 hashes: int = HELD_HASHES, texts: int = HELD_TEXTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` collocations."""
    frequent, sizes = frequent_phrases(docs, text, lang, support, most, block, shard, hashes, texts)
    scored = cut_scores(frequent, sizes).join(absorbed(frequent, inside_percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
