"""Phrase collocations by prefix-free parsing.

1. Parsing.  Texts fall into pieces at punctuation and line ends, pieces into words.  A word whose hash is divisible by ``TRIGGER`` closes a chunk;
   the next chunk starts with the last ``MOST - 1`` words before it once more, so that every phrase of up to ``MOST`` words lies in a chunk.
   A phrase belongs to the chunk in which its last word is not one of these repeated words: overlaps are assigned once.  Chunks end by content,
   so equal passages give equal chunks wherever they stand, and the dictionary of distinct chunks with their frequencies stands for the
   corpus.
2. Counting.  Phrases are counted inside distinct chunks, weighted by the frequencies.  A long phrase can only be frequent if its pairs of
   neighbouring words are; pairs are first counted by a hash of ``HASH_BITS`` bits, and a bitmap of ``FILTER_BITS`` bits (8 MB at any size of the input)
   marks the frequent ones.  Phrases with an unmarked pair are not counted; a mark too many only costs time.
3. Scoring.  Candidates meet the counts of their parts in joins on (lang, part).

All is per ``lang`` (null: ``und``).  A null or empty text has no words; a text of any length is parsed in words, a run of ``RUN`` words without a trigger is
cut; repeated rows count each time; ties are settled by count and phrase.  An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.llm.common import materialize, slices, texts
from pricelode.llm.word_codes import Numbering
from pricelode.llm.word_hash import BASE, mix, powers

MOST = 3
TRIGGER = 16
RUN = 4096
#: Bytes up to which words are hashed together; a longer word is hashed by the library.
LONG = 64
#: Exact for counts of up to 15 digits: no product has more than 38.
SCORE = "(CAST(1000000 AS decimal(7,0)) * (CAST(a AS decimal(15,0)) * CAST(a AS decimal(15,0)))) div (CAST(l AS decimal(18,0)) * CAST(r AS decimal(18,0)))"
SLICE = 4 << 20
#: Bytes after which a block of chunks is closed.
BLOCK = 4 << 20
HASH_BITS = 44
FILTER_BITS = 1 << 26
#: Ranges of pair hashes for each shuffle partition.
RANGES = 8
_PIECE = np.array([chr(b) in ".,;:!?\n\v\f\r" for b in range(256)])
_BLANK = np.array([chr(b) in " \t" for b in range(256)]) | _PIECE


def word_hashes(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every word; words advance together, byte by byte, the longest ones first."""
    order = np.argsort(255 - np.minimum(size, 255).astype(np.uint8), kind="stable")
    at, left = start[order], size[order]
    found = left.astype(np.uint64)
    long = int((size > LONG).sum())
    view = memoryview(buffer)
    for i in range(long):
        found[i] = xxhash.xxh64_intdigest(view[at[i] : at[i] + left[i]])
    m = len(order)
    for byte in range(LONG):
        m = int(np.searchsorted(-left[:m], -byte, side="left"))  # words with more bytes than that
        if m <= long:
            break
        found[long:m] = found[long:m] * BASE + buffer[at[long:m] + byte]
    out = np.empty_like(found)
    out[order] = mix(found)
    return out


class Words:
    """Words of a buffer: start, end, the number of the piece that each lies in, and a hash of its bytes."""

    def __init__(self, buffer: np.ndarray):
        word = ~_BLANK[buffer]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.piece = np.cumsum(_PIECE[buffer], dtype=np.int32)[self.start]
        self.hash = word_hashes(buffer, self.start, self.end - self.start)


def parse(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text, repeated words at its start, bytes) of every chunk; words of a chunk are joined by a space."""
    raw = np.frombuffer(b"\n".join(data).lower() + b"\n", np.uint8)
    words = Words(raw)
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    opens = np.diff(words.piece, prepend=-1) != 0
    head = np.maximum.accumulate(np.where(opens, np.arange(n), 0))  # first word of the own piece
    opens[1:] |= words.hash[:-1] % np.uint64(TRIGGER) == 0
    first = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    opens |= (np.arange(n) - first) % RUN == 0
    low = np.flatnonzero(opens)
    high = np.append(low[1:], n)
    again = np.minimum(low - head[low], MOST - 1)
    text = np.searchsorted(np.cumsum([len(x) + 1 for x in data]), words.start[low], side="right")
    sizes = words.end - words.start  # words joined by single spaces, each with one behind it
    end = np.cumsum(sizes + 1) - 1
    keep = ~_BLANK[raw]
    behind = np.zeros(len(raw), bool)
    behind[1:] = keep[:-1]
    joined = np.where(keep, raw, np.uint8(32))[keep | behind].tobytes()
    edges = zip((end - sizes)[low - again].tolist(), end[high - 1].tolist())
    return text, again, [joined[a:b] for a, b in edges]


def chunk_rows(batches):
    """Rows (lang, text) to (lang, again, chunk, n): chunks counted slice by slice."""
    for batch in batches:
        data, langs = texts(batch.column(1)), batch.column(0).to_pylist()
        for a, b in slices([len(x) for x in data], SLICE):
            text, again, chunks = parse(data[a:b])
            found = Counter(zip(map(langs[a:b].__getitem__, text.tolist()), again.tolist(), chunks))
            kinds = [pa.string(), pa.int32(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(found.values()), pa.int64())], names=["lang", "again", "chunk", "n"])


def chunk_dictionary(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, again, chunk, n): distinct chunks of all texts, the words at the start that another chunk owns, and the frequency."""
    rows = df.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    counted = rows.mapInArrow(chunk_rows, "lang string, again int, chunk binary, n long")
    return materialize(counted.groupBy("lang", "again", "chunk").agg(F.sum("n").alias("n")), "chunks")


class Block:
    """Some chunks of the dictionary as arrays of words: ``hash`` with the language in it, ``weight``, and whether a word counts here."""

    def __init__(self, table: pa.Table):
        chunks = table.column("chunk").combine_chunks()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), b"\n")[0]
        self.buffer = joined.as_py() + b"\n"
        self.words = Words(np.frombuffer(self.buffer, np.uint8))
        langs = table.column("lang").combine_chunks().dictionary_encode()
        self.langs, codes = langs.dictionary, langs.indices.to_numpy()
        of_lang = np.array([hash_of(x) for x in self.langs.to_pylist()], np.uint64)
        chunk = self.words.piece  # the line ends between chunks are the only piece ends
        first = np.flatnonzero(np.diff(chunk, prepend=-1))
        self.place = np.arange(len(chunk)) - first[chunk]
        self.own = self.place >= table.column("again").to_numpy()[chunk]
        self.lang, self.weight = codes[chunk], table.column("n").to_numpy()[chunk]
        self.hash = self.words.hash + of_lang[self.lang]

    def pairs(self) -> np.ndarray:
        """Hash of the pair that ends in each word."""
        out = np.zeros(len(self.hash), np.uint64)
        out[1:] = mix(self.hash[:-1] * BASE + self.hash[1:]) & np.uint64((1 << HASH_BITS) - 1)
        return out


def hash_of(name: str) -> int:
    data = np.frombuffer(name.encode("utf-8", "surrogatepass") + b"\0", np.uint8).astype(np.uint64)
    return int(mix((data + np.uint64(1)) * powers(BASE, len(data))).sum(dtype=np.uint64))


def blocks(batches):
    """Batches of dictionary rows joined to blocks of about ``BLOCK`` bytes."""
    held, size = [], 0
    for batch in batches:
        for a, b in slices(pc.binary_length(batch.column("chunk")).to_pylist(), BLOCK):
            held.append(batch.slice(a, b - a))
            size += held[-1].nbytes
            if size >= BLOCK:
                yield Block(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield Block(pa.Table.from_batches(held))


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in key order, places in it where a key starts, rank of every row's key among the distinct ones)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), rank


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of every distinct key, sum of its weights)."""
    order, new, _ = ranked(keys)
    return order[new], np.add.reduceat(weights[order], new) if len(new) else np.zeros(0, np.int64)


def pair_rows(parts: int):
    """Dictionary rows to (part, pairs, counts): hashes of word pairs in order with their weighted counts, a range of hashes in a row."""

    def run(batches):
        edges = np.linspace(0, 1 << HASH_BITS, parts + 1).astype(np.uint64)[1:-1]
        for block in blocks(batches):
            rows = np.flatnonzero(block.own & (block.place > 0))
            pair = block.pairs()[rows]
            one, n = summed(pair, block.weight[rows])
            pair = pair[one]
            cuts = [0, *np.searchsorted(pair, edges).tolist(), len(pair)]
            held = [i for i in range(parts) if cuts[i] < cuts[i + 1]]
            packed = [pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in held], pa.binary()) for x in (pair, n)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *packed], names=["part", "pairs", "counts"])

    return run


def often(least: int):
    """Rows (part, pairs, counts), by part, to (pair): those that count ``least`` or more."""

    def totals(pairs: list, counts: list) -> pa.RecordBatch:
        pair, count = (np.frombuffer(b"".join(x), np.int64) for x in (pairs, counts))
        one, n = summed(pair, count)
        return pa.RecordBatch.from_arrays([pa.array(pair[one[n >= least]])], names=["pair"])

    def run(batches):
        now, pairs, counts = None, [], []
        for batch in batches:
            for part, x, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if part != now and pairs:
                    yield totals(pairs, counts)
                    pairs, counts = [], []
                now = part
                pairs.append(x)
                counts.append(y)
        if pairs:
            yield totals(pairs, counts)

    return run


def frequent_pairs(dictionary: DataFrame, least: int) -> np.ndarray:
    """Bitmap of ``FILTER_BITS`` bits with the bit of every pair hash that counts ``least`` or more.

    Hashes are dealt by ranges, some for each shuffle partition; a task adds up one range at a time.
    """
    parts = int(dictionary.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES
    dealt = dictionary.mapInArrow(pair_rows(parts), "part int, pairs binary, counts binary").repartition("part").sortWithinPartitions("part")
    bit = F.col("pair") % FILTER_BITS + 1  # Spark numbers bits from 1, in parts of 32768
    marked = dealt.mapInArrow(often(least), "pair long").groupBy(F.bitmap_bucket_number(bit).alias("part"))
    marked = marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in marked.toLocalIterator():
        bits = np.frombuffer(row["bits"], np.uint8)
        out[(row["part"] - 1) * len(bits) : row["part"] * len(bits)] = bits
    return out


def phrase_counts(dictionary: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, n): every phrase of 1 to ``MOST`` words that stands ``least`` times or more."""
    marks = dictionary.sparkSession.sparkContext.broadcast(frequent_pairs(dictionary, least))

    def run(batches):
        bits = marks.value
        for block in blocks(batches):
            pair = (block.pairs() % np.uint64(FILTER_BITS)).astype(np.int64)
            marked = (bits[pair >> 3] >> (pair & 7).astype(np.uint8) & 1).astype(bool) & (block.place > 0)
            names = Numbering()
            ids = np.fromiter(map(names.__getitem__, block.buffer.split()), np.int64, len(pair))
            one = pa.array(names.new, pa.binary())
            _, _, word = ranked(ids * len(block.langs) + block.lang)
            good, key = block.own, word
            for size in range(1, MOST + 1):
                if size > 1:  # the phrase that ends a word before, and this word
                    _, _, key = ranked(_back(key, 1) * len(word) + word)
                    good = good & _back(marked, size - 2) & (block.place >= size - 1)
                rows = np.flatnonzero(good)
                at, n = summed(key[rows], block.weight[rows])
                last = rows[at]
                parts = [one.take(pa.array(ids[last - o])) for o in range(size - 1, -1, -1)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if size > 1 else parts[0]
                lang = block.langs.take(pa.array(block.lang[last]))
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(n), size, np.int32)), pa.array(n)], names=["lang", "phrase", "words", "n"])

    counted = dictionary.mapInArrow(run, "lang string, phrase binary, words int, n long")
    counted = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return materialize(counted.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def _back(values: np.ndarray, steps: int) -> np.ndarray:
    """The value ``steps`` words before; zeros at the start."""
    out = np.zeros_like(values)
    out[steps:] = values[: len(values) - steps] if steps else values
    return out


def part(first: Column | int, size: Column | int) -> Column:
    """Words of ``phrase`` from ``first`` (1 and up) on, ``size`` of them."""
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def collocations(df: DataFrame, least: int = 10, top: int = 2000, percent: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of every language: (lang, rank, phrase, a, l, r, n, score)."""
    dictionary = chunk_dictionary(df, text, lang)
    spaces = F.length("chunk") - F.length(F.replace(F.col("chunk").cast("string"), F.lit(" ")).cast("binary"))
    words = dictionary.groupBy("lang").agg(F.sum(F.col("n") * (spaces + 1 - F.col("again"))).alias("n_all"))
    counts = phrase_counts(dictionary, least)
    phrases = counts.filter("words > 1").withColumnRenamed("n", "a")
    inside = phrases.filter("words > 2").select(
        "lang", F.col("a").alias("outer"), F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda i: part(i, 2))).alias("phrase")
    )
    inside = inside.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    left = phrases.join(inside, ["lang", "phrase"], "left").filter("outer IS NULL OR 100 * outer < %d * a" % percent)
    cuts = left.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    scored = scored.withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_all").alias("n"), "score")


def phrase_query(documents: DataFrame) -> DataFrame:
    return collocations(documents)


PHRASE_SQL = """
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
f AS (
  SELECT lang, words, phrase, count(*) AS f
  FROM (
    SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase
    FROM (SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) v(words)))
  GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
scored AS (
  SELECT cuts.*, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (
  SELECT c.lang, c.phrase
  FROM c JOIN (SELECT lang, a AS outer_a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE words = 3) o
    ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE 100 * outer_a >= 50 * a)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n.n, score::BIGINT AS score
FROM best b JOIN n ON n.lang = b.lang
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = b.lang AND g.phrase = b.phrase)
QUALIFY rank <= 2000
"""
