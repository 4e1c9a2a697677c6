r"""Quality rules: counting rules, and the perplexity under an n-gram model of each language.

The models are interpolated modified Kneser-Ney models of ORDER characters, one of each value of ``lang`` and one of all
documents.  Spark counts the n-grams of all whole documents, derives the lower orders' continuation counts and writes
them, sorted, as arrays of n-gram keys and counts into the shared folder, in files of about PART entries by language,
order and range of contexts; nothing of it passes through the driver, and it grows with the corpus.  Discounts come
from each order's counts of counts.  A task looks n-grams up file by file and keeps at most CACHE bytes of them.

A key holds BITS bits a character: code points below 2**BITS (the alphabets from Latin to Tibetan) as they are, others
hashed.  Each document is judged by what the rest of the corpus says: its own counts are taken out of all orders'
counts, context totals and counts of counts by arithmetic (``Scorer``), which equals a model trained without it
(with the discounts of all).

A document's log perplexity is the median of its segments' (SEGMENT characters each), so that a key, an address or a
quoted line in it doesn't speak for the whole.  Each language has its own band of it, under its own model and under that of all documents: the median
of its documents that pass the counting rules, plus and minus WIDTH robust standard deviations.  A document is rejected
if both models put it on the same side outside.  (Under the model of all documents, prose of several languages isn't
unlikely, and a rare language has a model to lean on.)  The deviation of a language with few documents leans on that of
all: it counts SHRINK documents of the common one.

Words are ``[^\x20\x09-\x0D]+``.  Nulls: a null text has no words, so it fails; a null lang is a language of
its own; a null doc_id is kept as it is.  Repeated documents are counted and judged one by one, as are rows of equal
doc_id.  Values on a band's edge are inside.  Other columns of the documents are carried along and never looked at.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellward.llm import textops as t
from cellward.llm.sparkops import carried, cut, free_names, fresh_dir, table

ORDER, BITS = 4, 12
#: Half the band in robust standard deviations, and documents of the common deviation that each language's counts.
WIDTH, SHRINK = 6.0, 10
#: Characters of a segment.
SEGMENT = 100
#: Bytes of text that are judged at a time; arrays of 200 to 300 times that are at work meanwhile.
JUDGED = 1 << 18
#: Bins of log perplexity a nat.
BINS = 1000
#: Entries of a file, counts that a task gathers before it hands them on, and bytes of files that a worker keeps.
PART, GATHER, CACHE = 1 << 21, 1 << 21, 256 << 20
#: Rows of bands that are broadcast.
FEW_BANDS = 10_000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Key of the model of all documents; those of languages start with a letter of their own.
ALL = "all"
_WIDE = BITS * ORDER
_MARK = np.isin(np.arange(256), list(b"#*$%&|<>"))


def symbols(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text of each character, and the key of the n-gram of ORDER characters that it ends; 0 stands before a text."""
    texts = [b.decode("utf-8", "replace").replace("\0", "�") for b in bodies]
    point = np.frombuffer("".join("\0" * (ORDER - 1) + x for x in texts).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER - 1
    high = point >= 1 << BITS
    symbol = point.astype(np.int64)
    symbol[high] = 1 + (t.mix(point[high].astype(np.uint64)) % np.uint64((1 << BITS) - 1)).astype(np.int64)
    key = symbol.copy()
    for i in range(1, ORDER):
        key[i:] |= symbol[:-i] << (BITS * i)
    begins = np.zeros(len(key), bool)
    start = np.cumsum(size) - size
    for i in range(ORDER - 1):
        begins[start + i] = True
    return np.repeat(np.arange(len(texts)), size)[~begins], key[~begins]


def _count(batches):
    """(lang, gram, n) of a partition, some of them in several rows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return gram, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def flush():
        for lang, parts in held.items():
            gram, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(gram), np.int8))), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch, bodies in t.slices(batches):
        text, gram = symbols(bodies)
        langs, of_row = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
        own = of_row[text]
        for i, lang in enumerate(langs.tolist()):
            here = gram[own == i]
            if len(here):
                found = np.unique(here, return_counts=True)
                held.setdefault(lang, []).append(found)
                size += len(found[0])
        if size > GATHER:
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            size = sum(len(p[0][0]) for p in held.values())
            if size > GATHER // 2:
                yield from flush()
                size = 0
    yield from flush()
    t.release()


def language(lang: str = "lang"):
    """A language's key: safe as a folder's name, apart from ALL and from the one for null."""
    return F.coalesce(F.concat(F.lit("x"), F.hex(F.col(lang).cast("string"))), F.lit("null"))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, ord, gram, n) of all orders: counts of the highest, numbers of different characters before it of the others."""
    rows = docs.select(F.col("text").cast("string").alias("text"), language().alias("lang"))
    own = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    own = cut(own)
    level = cut(own.union(own.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "gram", "n")))
    levels = level.select("lang", F.lit(ORDER).alias("ord"), "gram", "n")
    for order in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels = levels.union(level.select("lang", F.lit(order).alias("ord"), "gram", "n"))
    return levels


def train(docs: DataFrame, part: int = PART) -> str:
    """Counts all documents and writes the models; returns their folder."""
    folder = fresh_dir(docs.sparkSession, "perplexity")
    levels = cut(counted(docs))
    several = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    levels.groupBy("lang", "ord").agg(*several).write.partitionBy("lang").parquet(f"{folder}/counts")
    ranges = max(1, math.ceil(levels.count() / part))
    # a context's n-grams stay in one file, and the files' names follow the ranges
    dealt = levels.withColumn("context", F.shiftright("gram", BITS)).repartitionByRange(ranges, "lang", "ord", "context").sortWithinPartitions("lang", "ord", "gram")
    dealt.select("lang", "ord", "gram", "n").write.partitionBy("lang", "ord").parquet(f"{folder}/grams")
    return folder


def discounts(counts) -> np.ndarray:
    """Of counts 0 to 3 and more, from the numbers of n-grams with counts 1 to 4; half a count where there are none."""
    y = counts[0] / (counts[0] + 2 * counts[1]) if counts[0] else 0.0
    out = [i - (i + 1) * y * counts[i] / counts[i - 1] if counts[i - 1] else 0.5 * i for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.01), i + 0.99) for i, d in enumerate(out))])


class Part:
    """The sorted n-grams of a file, and for each context the sum and the counts of counts of its n-grams."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.gram, self.n = gram, n
        context = gram >> BITS
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        self.context, self.total = context[first], np.add.reduceat(n, first)
        self.kinds = [np.add.reduceat((np.minimum(n, 3) == i).astype(np.int64), first) for i in (1, 2, 3)]
        self.size = 16 * len(gram) + 40 * len(first)


class Models:
    """The written models as a worker sees them."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.files: dict[tuple, list[str]] = {}
        self.d: dict[tuple, np.ndarray] = {}
        self.parts: OrderedDict[str, Part] = OrderedDict()

    def _paths(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(x.path for x in found if x.base_name.endswith(".parquet"))

    def _read(self, path: str) -> pa.Table:
        with self.store.open_input_file(path) as f:
            return pq.ParquetFile(f).read()

    def discounts(self, lang: str, order: int) -> np.ndarray:
        if (lang, order) not in self.d:
            for path in self._paths(f"{self.root}/counts/lang={lang}"):
                rows = self._read(path).to_pydict()
                for i, o in enumerate(rows["ord"]):
                    self.d[lang, o] = discounts([rows[f"n{j}"][i] for j in (1, 2, 3, 4)])
            self.d.setdefault((lang, order), discounts([0, 0, 0, 0]))
        return self.d[lang, order]

    def all_parts(self, lang: str, order: int):
        if (lang, order) not in self.files:
            self.files[lang, order] = self._paths(f"{self.root}/grams/lang={lang}/ord={order}")
        for path in self.files[lang, order]:
            if path in self.parts:
                self.parts.move_to_end(path)
            else:
                rows = self._read(path)
                self.parts[path] = Part(rows["gram"].to_numpy(), rows["n"].to_numpy())
                while len(self.parts) > 1 and sum(x.size for x in self.parts.values()) > CACHE:
                    self.parts.popitem(last=False)
            yield self.parts[path]

    def look_up(self, lang: str, order: int, gram: np.ndarray, context: np.ndarray):
        """Counts of n-grams; sums and counts of counts of contexts; 0 for what isn't there."""
        n, total, kinds = np.zeros(len(gram), np.int64), np.zeros(len(context), np.int64), np.zeros((3, len(context)), np.int64)
        for part in self.all_parts(lang, order):
            at = t.look_up(part.gram, gram)
            n = np.where(at >= 0, part.n[at], n)
            at = t.look_up(part.context, context)
            total = np.where(at >= 0, part.total[at], total)
            kinds = np.where(at >= 0, np.stack([k[at] for k in part.kinds]), kinds)
        return n, total, kinds


def segment_medians(text: np.ndarray, loss: np.ndarray, size: int, segment: int = SEGMENT) -> np.ndarray:
    """Of each text the median of its segments' means; 0 for an empty text.  ``text`` is in order."""
    seen = np.bincount(text, minlength=size)
    first = np.cumsum(seen) - seen
    many = np.maximum(seen // segment, 1)  # what is left over belongs to the last segment
    begin = np.cumsum(many) - many
    part = begin[text] + np.minimum((np.arange(len(text)) - first[text]) // segment, many[text] - 1)
    mean = np.bincount(part, loss, minlength=int(many.sum())) / np.maximum(np.bincount(part, minlength=int(many.sum())), 1)
    mean = mean[np.lexsort((mean, np.repeat(np.arange(size), many)))]
    return (mean[begin + (many - 1) // 2] + mean[begin + many // 2]) / 2


class Scorer:
    """Log perplexities of texts under models without the texts' own counts.

    Which n-grams, contexts and endings each text has is worked out once and serves for every model.
    """

    def __init__(self, models: Models, bodies: list[bytes]):
        self.models, self.size = models, len(bodies)
        self.text, gram = symbols(bodies)
        self.key, self.place, self.own = np.unique((self.text << _WIDE) | gram, return_inverse=True, return_counts=True)
        self.levels, key = [], self.key
        for order in range(ORDER, 0, -1):
            of_text, gram = key >> _WIDE << _WIDE, key & ((1 << _WIDE) - 1)
            context, of = np.unique(of_text | (gram >> BITS), return_inverse=True)
            following, at = np.unique(of_text | (gram & ((1 << (BITS * (order - 1))) - 1)), return_inverse=True)
            self.levels.append((order, key, context, of, following, at))
            key = following

    def score(self, lang: str | list[str]) -> np.ndarray:
        """Log perplexity of each text by its segments, under one model or each text's own; 0 for an empty text."""
        if not len(self.key):
            return np.zeros(self.size)
        names, model = np.unique(np.array([lang] if isinstance(lang, str) else lang, object), return_inverse=True)
        model = np.broadcast_to(model, self.size) if isinstance(lang, str) else model
        low, own, terms = (1 << _WIDE) - 1, self.own, []
        for order, key, context, of, following, at in self.levels:
            n, total, kinds, d = np.zeros(len(key), np.int64), np.zeros(len(context), np.int64), np.zeros((3, len(context)), np.int64), np.zeros((len(names), 4))
            of_key, of_context = model[key >> _WIDE], model[context >> _WIDE]
            for i, name in enumerate(names.tolist()):
                mine, there = (slice(None), slice(None)) if len(names) == 1 else (np.flatnonzero(of_key == i), np.flatnonzero(of_context == i))
                n[mine], total[there], kinds[:, there] = self.models.look_up(name, order, key[mine] & low, context[there] & low)
                d[i] = self.models.discounts(name, order)
            rest = np.maximum(n - own, 0)
            total = total - np.bincount(of, n - rest, minlength=len(context))
            free = np.zeros(len(context))
            for i in (1, 2, 3):
                moved = (np.minimum(rest, 3) == i).astype(np.int64) - (np.minimum(n, 3) == i)
                free += d[of_context, i] * (kinds[i - 1] + np.bincount(of, moved, minlength=len(context)))
            total, free = total[of], free[of]
            known, some = total > 0, np.maximum(total, 1)
            terms.append((np.where(known, (rest - d[of_key, np.minimum(rest, 3)]) / some, 0.0), np.where(known, free / some, 1.0), at))
            # what only this text has is one n-gram less for its ending
            own = np.bincount(at, (n > 0) & (rest == 0), minlength=len(following)).astype(np.int64)
        p = np.full(len(self.levels[-1][4]), 1.0 / (1 << BITS))
        for first, weight, at in reversed(terms):
            p = first + weight * p[at]
        return segment_medians(self.text, -np.log(p)[self.place], self.size)


def features(bodies: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of FEATURES for each text."""
    words = t.Words(bodies, t.SPACES)
    raw, starts, ends = t.joined(bodies)
    k = len(bodies)
    text_of = np.repeat(np.arange(k), ends - starts + 1)
    out = {"n_words": words.count.astype(np.int64)}
    out["word_chars"] = t.per_text(text_of, k, (words.buf != 0) & ((raw & 0xC0) != 0x80))
    out["n_symbols"] = t.per_text(text_of, k, _MARK[raw])
    # a line's end is a line feed or the byte after its text
    end = np.flatnonzero(raw == 0x0A)
    start = np.append(0, end[:-1] + 1)
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[worded], end[worded]
    own = text_of[start]
    salt = t.mix(np.arange(1, k + 1, dtype=np.uint64))
    first = np.unique(t.mix(t.Rolling(raw).of(start, end) ^ salt[own]), return_index=True)[1]
    again = np.ones(len(own), bool)
    again[first] = False
    out["n_dup_lines"] = t.per_text(own, k, again)
    gram, ok = t.gram_hash(words.hash, 3), t.in_one(words.text, 3)
    at = np.flatnonzero(ok)
    _, same, n = np.unique(t.mix(gram[at] ^ salt[words.text[at]]), return_inverse=True, return_counts=True)
    out["n_repeat_words"] = t.per_text(words.text, k, t.spread(at[n[same] > 1], 3, len(words.text)))
    return out


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _models(folder: str) -> Models:
    """The worker's models; it keeps those of the last folder only."""
    return t.held(("models", folder), lambda: Models(folder))


def _judged(folder: str, bodies: list[bytes], langs: list[str]):
    """Counts, base_failed, and the two log perplexities of texts."""
    f, scorer = features(bodies), Scorer(_models(folder), bodies)
    return f, base_failed(f), scorer.score(langs), scorer.score(ALL)


def score(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, lang's key, FEATURES, base_failed, log_ppl (of the language's model) and log_ppl_all of each document."""

    def run(batches):
        for batch, bodies in t.slices(batches, limit=JUDGED):
            f, failed, own, common = _judged(folder, bodies, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(f[c]) for c in FEATURES), pa.array(failed), pa.array(own), pa.array(common)], names=["doc_id", "lang", *FEATURES, "base_failed", "log_ppl", "log_ppl_all"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), language().alias("lang"))
    return rows.mapInArrow(run, f"doc_id long, lang string, {', '.join(f'{c} long' for c in FEATURES)}, base_failed boolean, log_ppl double, log_ppl_all double")


def _middles(bins: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """The lower median of a histogram (value, n) of each group; a group has at most a few ten thousand bins."""
    w = Window.partitionBy(*by)
    up = bins.withColumn("upto", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("of", F.sum("n").over(w))
    return up.where("2 * upto >= of").groupBy(*by).agg(F.min(value).alias(out), F.first("of").alias("of"))


def bands(scored: DataFrame, width: float = WIDTH, shrink: float = SHRINK) -> DataFrame:
    """(lang, low, high, low_all, high_all) of each language with documents that pass the counting rules."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("model"), F.col("log_ppl").alias("v")), F.struct(F.lit(1).alias("model"), F.col("log_ppl_all").alias("v"))))
    values = scored.where("not base_failed").select("lang", both.alias("x")).select("lang", "x.model", F.floor(F.col("x.v") * BINS).alias("bin"))
    bins = cut(values.groupBy("lang", "model", "bin").agg(F.count(F.lit(1)).alias("n")))
    middle = _middles(bins, ["lang", "model"], "bin", "middle")
    off = bins.join(middle.select("lang", "model", "middle"), ["lang", "model"]).withColumn("off", F.abs(F.col("bin") - F.col("middle")))
    own = _middles(off.groupBy("lang", "model", "off").agg(F.sum("n").alias("n")), ["lang", "model"], "off", "spread")
    common = _middles(off.groupBy("model", "off").agg(F.sum("n").alias("n")), ["model"], "off", "common").drop("of")
    found = own.join(common, "model").join(middle.select("lang", "model", "middle"), ["lang", "model"])
    # a value lies anywhere in its bin
    spread = F.sqrt((F.col("of") * F.col("spread") * F.col("spread") + shrink * F.col("common") * F.col("common")) / (F.col("of") + shrink))
    found = found.withColumn("half", width * 1.4826 * spread + 1.0)
    edge = lambda model, sign: F.max(F.when(F.col("model") == model, (F.col("middle") + 0.5 + sign * F.col("half")) / BINS))
    return found.groupBy("lang").agg(edge(0, -1).alias("low"), edge(0, 1).alias("high"), edge(1, -1).alias("low_all"), edge(1, 1).alias("high_all"))


def with_bands(scored: DataFrame, found: DataFrame, lang: str) -> DataFrame:
    """Each row with its language's band: broadcast while there are few languages, else joined."""
    (key,) = free_names([*scored.columns, *found.columns], "key")
    found = cut(found.withColumnRenamed("lang", key))
    if found.count() <= FEW_BANDS:
        found = F.broadcast(found)
    return scored.join(found, F.col(lang) == F.col(key), "left").drop(key)


def _kept(failed: str, own: str, common: str, names: tuple[str, str, str, str]):
    low, high, low_all, high_all = map(F.col, names)
    over, under = (F.col(own) > high) & (F.col(common) > high_all), (F.col(own) < low) & (F.col(common) < low_all)
    return ~F.col(failed) & ~F.coalesce(over | under, F.lit(False))


_EDGES = ("low", "high", "low_all", "high_all")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, base_failed, both log perplexities and kept."""
    scored = cut(score(docs, train(docs)))
    return with_bands(scored, bands(scored), "lang").withColumn("kept", _kept("base_failed", "log_ppl", "log_ppl_all", _EDGES)).drop(*_EDGES)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules and the bands keep, with their own columns, whatever those are called."""
    return carried(docs, _keep)


def _keep(docs: DataFrame) -> DataFrame:
    folder, names = train(docs), docs.columns
    body, lang, failed, own, common = free_names([*names, *_EDGES, "lang"], "body", "language", "failed", "own", "common")
    rows = docs.select("*", F.col("text").cast("string").alias(body), language().alias(lang))

    def run(batches):
        for batch, bodies in t.slices(batches, body, JUDGED):
            _, bad, v, w = _judged(folder, bodies, batch.column(len(names) + 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], batch.column(len(names) + 1), pa.array(bad), pa.array(v), pa.array(w)], names=[*names, lang, failed, own, common])

    fields = [T.StructField(lang, T.StringType()), T.StructField(failed, T.BooleanType()), T.StructField(own, T.DoubleType()), T.StructField(common, T.DoubleType())]
    scored = cut(rows.mapInArrow(run, T.StructType([*docs.schema.fields, *fields])))
    edges = dict(zip(_EDGES, free_names([*scored.columns, "lang"], *_EDGES)))
    found = bands(scored.select(F.col(lang).alias("lang"), F.col(failed).alias("base_failed"), F.col(own).alias("log_ppl"), F.col(common).alias("log_ppl_all"))).withColumnsRenamed(edges)
    return with_bands(scored, found, lang).where(_kept(failed, own, common, tuple(edges.values()))).select(*names)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *FEATURES, "base_failed", "kept", F.round("log_ppl", 6).alias("log_ppl"), F.round("log_ppl_all", 6).alias("log_ppl_all"))
