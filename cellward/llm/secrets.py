r"""Secret scans in SQL expressions alone: three fixed patterns, and a battery of randomness tests.

Fixed kinds, leftmost and without overlaps each: ``assign`` (a key word, = or :, and a value of 12 or more),
``access`` (AKIA and more, 18 or more) and ``hex`` (16 or more).  Positions are code points; ends are exclusive.

The battery takes every run of 16 or more of ``[A-Za-z0-9+/_-]``, infers its encoding (digits, hexadecimal,
letters of one case, base 32, base 36, letters, base 62, base 64), and tests it for uniform use of that alphabet
(chi-squared), for the number of runs above and below the alphabet's middle, and for serial correlation.  The three
standard scores give one score, small for random text.  Runs that overlap a fixed span are neither tested nor counted.

A cut is set for each size of alphabet and length class by false-discovery control: all words of all documents serve as
decoys in every class.  For each class a document's words, joined without spaces, are cut from the first to the last into pieces
of its length, and each piece is tested in every alphabet; a small fixed stock is added, so that there always are some.  The cut is the largest score at which the
expected share of such text among the runs below it is FDR at most: (decoys below + 1) / (decoys + 1), times the number of
runs that are no secret, over the runs below.  That number is estimated from those above LARGEST.  Only numbers of decoys by
class, alphabet and score leave the tasks.  Spans of kind ``random`` are added.

Nulls: a null text is empty and stays null when redacted; a null doc_id is kept.  Repeated documents are scanned one by
one.  Other columns are carried along and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm.sparkops import carried, cut, free_names, setting, table, texts

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
#: A run is a match if and only if it is long enough, so the length stands in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings from the narrowest: pattern and alphabet.
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[a-z]+$", _LOWER),
    (r"^[A-Z]+$", _UPPER),
    (r"^[a-z2-7]+$", _LOWER + "234567"),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[a-z0-9]+$", _LOWER + _DIGITS),
    (r"^[A-Z0-9]+$", _UPPER + _DIGITS),
    (r"^[A-Za-z]+$", _UPPER + _LOWER),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"", _UPPER + _LOWER + _DIGITS + "+/"),
)
#: Sizes of alphabets with cuts of their own; smaller ones, which words don't fit, share the last.
SIZES = (26, 32, 36, 52, 62, 64)
#: What has no letter or digit is no secret; a text's words that make up decoys (group 1), between all else.
BLANK, WORDS = r"^[-_/+]+$", r"([A-Za-z]{1,15})(?:[^A-Za-z0-9+/_-]+|$)|[A-Za-z0-9+/_-]+|[^A-Za-z0-9+/_-]+"
#: The stock: pieces of these words from COPIES places.
STOCK, COPIES = "theresultofthisworkwillbekeptinthesamefolderasallotherfilesandnooneshouldhavetochangethembyhandwhenthenextversionisreadybecauseeverystepiswrittendownbelow", 24
#: First lengths of the classes, accepted share of false discoveries, and the largest cut (99 % of random runs).
CLASSES, FDR, LARGEST = (16, 20, 28, 36, 48, 64), 0.05, 12
_BLOCK = 256


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; inside a lambda it would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / _BLOCK).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, _BLOCK))


def _running(values: Column, all_of) -> Column:
    """``all_of`` an array's earlier entries for each entry: over the blocks before its own, and within its own, so that long arrays stay cheap."""
    first = lambda a, n: F.slice(a, 1, n)
    within = lambda a, before: F.transform(a, lambda _, i: all_of(F.concat(F.array(before), first(a, i))))
    over = lambda blocks, each: F.flatten(F.transform(blocks, lambda a, b: _bound(all_of(first(each, b)), lambda before: within(a, before))))
    return _bound(values, lambda own: _bound(_blocks(own), lambda blocks: _bound(F.transform(blocks, all_of), lambda each: over(blocks, each))))


def _before(lengths: Column) -> Column:
    """Sum of all earlier entries for each entry of an array."""
    return _running(lengths, lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x))


def _reached(ends: Column) -> Column:
    """The largest earlier entry for each entry of an array of ends, 0 for the first."""
    return _running(ends, lambda a: F.coalesce(F.array_max(a), F.lit(0)))


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0, texts: bool = False) -> Column:
    """array<struct<start, kind, end>> of the matches of a pattern, with ``texts`` also what they match as q."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        size, gap = F.transform(found, lambda x: F.length(x)), F.transform(gaps, lambda x: F.length(x))
        start = F.zip_with(_before(F.zip_with(gap, size, lambda a, b: a + b)), gap, lambda a, b: a + b)
        own = lambda s, q: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(q)).alias("end"), *([q.alias("q")] if texts else []))
        return F.zip_with(start, found, own)

    out = _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if value_group:
        values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), lambda x: F.length(x))
        out = F.filter(F.zip_with(out, values, lambda s, n: F.when(n >= least, s)), lambda s: s.isNotNull())
    empty = F.expr(f"cast(array() as array<struct<start:int,kind:int,end:int{',q:string' if texts else ''}>>)")
    return F.when(F.regexp_like(text, F.lit(pattern)), out).otherwise(empty)


def _name(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _by_encoding(run: str, values: list[str]) -> str:
    """SQL for the value of a run's encoding."""
    out = values[-1]
    for (pattern, _), value in zip(reversed(ENCODINGS[:-1]), reversed(values[:-1])):
        out = f"if(rlike({run}, '{pattern}'), {value}, {out})"
    return out


#: The standard scores, from a run's length n, its alphabet's size k, and what is counted in it.
_MEAN_RUNS = "(2 * high * (n - high) / n + 1)"
_Z_CHI = "greatest(0D, (squares * k / n - n - k + 1) / sqrt(2 * (k - 1) * (n - 1) / n))"
_Z_RUNS = f"if({_MEAN_RUNS} > 2, (changes + 1 - {_MEAN_RUNS}) / sqrt(greatest(0.25D, ({_MEAN_RUNS} - 1) * ({_MEAN_RUNS} - 2) / (n - 1))), 9D)"
_Z_SERIAL = "serial / ((k * k - 1) / 12 * sqrt(n - 1))"


def score(run: str, alphabet: str | None = None) -> str:
    """SQL for the sum of the squared standard scores of the three tests; about chi-squared with 3 degrees for random runs."""
    alphabet = alphabet or _by_encoding("x", [f"'{letters}'" for _, letters in ENCODINGS])
    body = f"power({_Z_CHI}, 2) + power({_Z_RUNS}, 2) + power({_Z_SERIAL}, 2)"
    steps = "sequence(1, cast(n as int) - 1)"
    for name, value in (
        ("serial", f"aggregate({steps}, 0D, (a, i) -> a + (v[i] - (k - 1) / 2) * (v[i - 1] - (k - 1) / 2))"),
        ("changes", f"cast(size(filter({steps}, i -> (v[i] >= k / 2) != (v[i - 1] >= k / 2))) as double)"),
        ("high", "cast(size(filter(v, y -> y >= k / 2)) as double)"),
        ("squares", "aggregate(transform(sequence(0, cast(k as int) - 1), s -> cast(size(filter(v, y -> y = s)) as double)), 0D, (a, c) -> a + c * c)"),
        ("n", "cast(size(v) as double)"),
        ("v", "transform(split(x, ''), y -> instr(letters, y) - 1)"),
        ("k", "cast(length(letters) as double)"),
        ("letters", alphabet),
        ("x", f"translate({run}, '-_', '+/')"),
    ):
        body = _let(name, value, body)
    return body


def _class(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} >= {first} THEN {i}" for i, first in reversed([*enumerate(CLASSES)])) + " ELSE 0 END"


def _stratum(run: str) -> str:
    """SQL for the place in SIZES of a run's alphabet."""
    return _by_encoding(run, [str(SIZES.index(len(x)) if len(x) in SIZES else len(SIZES) - 1) for _, x in ENCODINGS])


_RUN = "struct<start:int,kind:int,end:int,c:int,e:int,score:double>"


def candidates(docs: DataFrame, base: str, runs: str) -> DataFrame:
    """The documents with two columns more: fixed spans (start, kind, end), and runs that overlap none with class, alphabet and score."""
    (body,) = free_names([*docs.columns, base, runs], "body")
    near = "exists(blocks, k -> k.low < r.end and r.start < k.high and exists(k.spans, b -> b.start < r.end and r.start < b.end))"
    blocks = f"""transform(transform(sequence(0, cast(floor((greatest(size({base}), 1) - 1) / {_BLOCK}) as int)), k -> slice({base}, k * {_BLOCK} + 1, {_BLOCK})),
        a -> named_struct('low', array_min(transform(a, b -> b.start)), 'high', array_max(transform(a, b -> b.end)), 'spans', a))"""
    free = _let("blocks", blocks, f"filter({runs}, r -> not coalesce({near}, false) and not rlike(r.q, '{BLANK}'))")
    tested = f"named_struct('start', r.start, 'kind', r.kind, 'end', r.end, 'c', {_class('length(q)')}, 'e', {_stratum('q')}, 'score', {score('q')})"
    text = F.col(body)
    return (
        docs.withColumn(body, F.coalesce(F.col("text").cast("string"), F.lit("")))
        .withColumn(base, F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, ASSIGN_VALUE), _spans(text, ACCESS, 1), _spans(text, HEX, 2))))
        .withColumn(runs, _spans(text, RUN, 3, texts=True))
        .withColumn(runs, F.expr(f"cast(transform({free}, r -> {_let('q', 'r.q', tested)}) as array<{_RUN}>)"))
        .drop(body)
    )


def _letters(each, join: str, none: str) -> str:
    """SQL that joins each(i) for the letters of a piece of n; stretches that a short piece doesn't reach are left out."""
    parts = [f" {join} ".join(each(i) for i in range(first, last)) for first, last in zip((0, *CLASSES), CLASSES)]
    return f" {join} ".join(f"if(n > {first}, {part}, {none})" for first, part in zip((0, *CLASSES), parts))


def coded(words: Column) -> Column:
    """Two digits for each letter: its place in the alphabet of both cases, from 01 for A to 52 for z; binary, where a piece is found without a walk from the first byte."""
    return F.hex(F.translate(words, _UPPER + _LOWER, "".join(chr(int(str(i), 16)) for i in range(1, 53)))).cast("binary")


def _decoy_steps() -> list[dict[str, str]]:
    """Steps of columns, each from those before, from a coded ``piece`` to ``bins``: its scores in all alphabets, rounded up to
    LARGEST + 1 at most, four bits each.

    As ``score``, for letters alone.  A letter stands in the same place of all alphabets of one case (l, from 1) and of all of both
    (v, from 1; both are 0 behind the end), so that these differ in size and middle alone.  Letters are counted in three longs,
    seven bits each (a; the upper-case ones alone in u), and bit i of a long says whether letter i is above a middle.
    All is spelled out letter by letter and free of lambdas, which Spark walks through instead of compiling them, and of branches
    by letter.  Sixteen digits are read as one number.
    """
    last, own = CLASSES[-1], {e: "l" if k < 52 else "v" for e, k in enumerate(SIZES)}
    digits = lambda i: f"w{i // 8} div {100 ** (7 - i % 8)}L % 100"
    ones = lambda t: f"cast(split('{','.join(str(1 << (y - 9 * t - 1) * 7 if 9 * t < y <= min(9 * t + 9, 26) else 0) for y in range(53))}', ',') as array<bigint>)"
    third = lambda x, t: _letters(lambda i: f"coalesce(get({ones(t)}, {x}{i}), 0L)", "+", "0L")
    above = lambda x, half: _letters(lambda i: f"shiftleft(bigint(shiftrightunsigned({half} - {x}{i}, 31)), {i})", "|", "0L")
    products = lambda x: _letters(lambda i: f"{x}{i} * {x}{i - 1}" if i else "0", "+", "0")
    count = lambda a, y: f"(shiftright({a}{y // 9}, {y % 9 * 7}) & 127L)"
    every = lambda each: " + ".join(map(each, range(26)))

    def two(e: int) -> str:
        runs = _Z_RUNS.replace(_MEAN_RUNS, f"mean{e}").replace("changes", f"changes{e}")
        return f"if(chi{e} > {LARGEST}, {LARGEST + 1}D, chi{e} + power({runs}, 2))"

    def three(e: int, k: int) -> str:
        x, m = own[e], (k + 1) / 2
        z = _Z_SERIAL.replace("serial", f"(products_{x} - {m}D * (2 * total_{x} - ends_{x}) + (n - 1) * {m * m}D)").replace("(k * k - 1)", f"{k * k - 1}D")
        return f"if(two{e} > {LARGEST}, {LARGEST + 1}, cast(least(ceil(two{e} + power({z}, 2)), {LARGEST + 1}) as int))"

    return [
        {"n": "shiftright(octet_length(piece), 1)", "padded": f"rpad(piece, {2 * last}, cast('0' as binary))"},
        {f"w{j}": f"if(n > {8 * j}, cast(cast(substr(padded, {16 * j + 1}, 16) as string) as bigint), 0L)" for j in range(last // 8)} | {"end": "cast(cast(substr(piece, -2) as string) as int)"},
        {f"v{i}": f"if(n > {i}, coalesce(cast({digits(i)} as int), 0), 0)" for i in range(last)} | {f"l{i}": f"if(n > {i}, coalesce(cast(({digits(i)} - 1) % 26 + 1 as int), 0), 0)" for i in range(last)},
        {f"a{t}": third("l", t) for t in range(3)}
        | {f"u{t}": f"if({above('v', 26)} = shiftrightunsigned(-1L, 64 - n), 0L, {third('v', t)})" for t in range(3)}
        | {f"above{e}": above(own[e], k // 2) for e, k in enumerate(SIZES)}
        | {f"products_{x}": products(x) for x in "lv"}
        | {"ends_v": "v0 + end", "ends_l": "l0 + if(end > 26, end - 26, end)"},
        # the upper-case letters count apart in alphabets of both cases
        {"same_l": every(lambda y: f"{count('a', y)} * {count('a', y)}"), "upper": every(lambda y: count("u", y)), "total_l": every(lambda y: f"{count('a', y)} * {y + 1}")},
        {"same_v": "same_l - 2 * (" + every(lambda y: f"{count('u', y)} * ({count('a', y)} - {count('u', y)})") + ")", "total_v": "total_l + 26 * (n - upper)"},
        {f"chi{e}": f"power({_Z_CHI.replace('squares', f'same_{own[e]}')}, 2)".replace("k", f"{k}D") for e, k in enumerate(SIZES)}
        | {f"changes{e}": f"bit_count((above{e} ^ shiftrightunsigned(above{e}, 1)) & shiftrightunsigned(-1L, 65 - n))" for e in own}
        | {f"mean{e}": _MEAN_RUNS.replace("high", f"double(bit_count(above{e}))") for e in own},
        {f"two{e}": two(e) for e in own},
        {"bins": " + ".join(f"shiftleft({three(e, k)}, {4 * e})" for e, k in enumerate(SIZES))},
    ]


def in_turn(codes: Column) -> Column:
    """A text's joined words, coded, cut from end to end into pieces of the classes' lengths in turn; each stretch serves one class."""
    size, turn = F.octet_length(codes), 2 * sum(CLASSES)
    starts = F.transform(F.sequence(F.lit(0), size, F.lit(turn)), lambda at: F.array(*(at + 2 * sum(CLASSES[:i]) for i in range(len(CLASSES)))))
    cut_up = lambda own: F.array(*(F.substring(codes, own[i] + 1, F.lit(2 * n)) for i, n in enumerate(CLASSES)))
    return F.filter(F.flatten(F.transform(starts, cut_up)), lambda x: F.octet_length(x) >= 2 * CLASSES[0])


def for_each_class(codes: Column) -> Column:
    """For each class a text's joined words, coded, cut from end to end into pieces of its length; what is left over stands with the letters before it in one more."""
    size, none = F.octet_length(codes), F.expr("cast(array() as array<int>)")
    starts = lambda n: F.when(size >= n, F.concat(F.sequence(F.lit(0), size - n, F.lit(n)), F.when(size % n > 0, F.array(size - n)).otherwise(none))).otherwise(none)
    some = lambda n: F.transform(starts(n), lambda at: F.substring(codes, at + 1, F.lit(n)))
    return F.concat(*(some(2 * n) for n in CLASSES))


def decoys(docs: DataFrame, pieces=in_turn) -> DataFrame:
    """(c, e, bin, rows): numbers of decoys by length class, alphabet and score, from all words of all documents, and from the stock."""
    spark = docs.sparkSession
    words = texts(docs).select(coded(F.regexp_replace("text", WORDS, "$1")).alias("words"))
    # a binary column is copied wherever a lambda names it
    piece = words.select(F.explode(_bound(F.col("words"), pieces)).alias("piece"))
    stock = spark.range(0, COPIES, 1, 1).select(F.explode(F.array(*map(F.lit, CLASSES))).alias("n"), (F.col("id") * 7 % len(STOCK)).cast("int").alias("at"))
    tested = piece.union(stock.select(coded(F.expr(f"substr(repeat('{STOCK}', 2), at + 1, n)"))))
    # nothing here can overflow: counts are 64 at most, in seven bits; each checked sum would be a call
    with setting(spark, "spark.sql.ansi.enabled", "false"):
        for step in _decoy_steps():
            tested = tested.select("*", *(F.expr(sql).alias(name) for name, sql in step.items()))
    kinds = tested.groupBy(F.expr(_class("n")).alias("c"), "bins").agg(F.count(F.lit(1)).alias("rows"))
    # not by exploding the bins: a filter on them would go down to the pieces and have all tests done twice
    each = kinds.withColumn("e", F.explode(F.array(*map(F.lit, range(len(SIZES))))))
    return each.groupBy("c", "e", F.expr("shiftright(bins, 4 * e) & 15").alias("bin")).agg(F.sum("rows").alias("rows"))


def cuts(found: DataFrame, runs: str, docs: DataFrame) -> dict[tuple[int, int], int]:
    """The largest accepted score of each length class and size of alphabet, from the candidates' runs and the documents' decoys."""
    own = found.select(F.explode(runs).alias("r")).groupBy("r.c", "r.e", F.expr(f"cast(least(ceil(r.score), {LARGEST + 1}) as int)").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    false = decoys(docs, for_each_class).select("c", "e", "bin", "rows", F.lit(True))
    # whole-stage code would make the decoys' steps one method, too large for the JVM to compile
    with setting(own.sparkSession, "spark.sql.codegen.wholeStage", "false"):
        bins = own.select("c", "e", "bin", "rows", F.lit(False).alias("decoy")).union(false).collect()  # a thousand at most
    count: dict[tuple[int, int, bool], list[int]] = {}
    for r in bins:
        count.setdefault((r["c"], r["e"], r["decoy"]), [0] * (LARGEST + 2))[r["bin"]] += r["rows"]
    none = [0] * (LARGEST + 2)
    return {(c, e): largest_cut(count.get((c, e, False), none), count.get((c, e, True), none)) for c in range(len(CLASSES)) for e in range(len(SIZES))}


def largest_cut(found: list[int], false: list[int]) -> int:
    """From the numbers of runs and decoys by score (the last is for all larger ones): the largest accepted score, 0 if there is none."""
    no_secrets = min(sum(found), found[-1] * (sum(false) + 1) / false[-1]) if false[-1] else sum(found)
    best = 0
    for s in range(1, LARGEST + 1):
        below, decoys = sum(found[: s + 1]), sum(false[: s + 1])
        if below and no_secrets * (decoys + 1) / (sum(false) + 1) <= FDR * below:
            best = s
    return best


def _spans_of(found: DataFrame, base: str, runs: str, spans: str, accepted: dict[tuple[int, int], int]) -> DataFrame:
    """Adds all spans in order: the fixed ones, and the runs under their cut."""
    limits = ", ".join(str(accepted[c, e]) for c in range(len(CLASSES)) for e in range(len(SIZES)))
    good = f"filter({runs}, r -> {_let('most', f'element_at(array({limits}), r.c * {len(SIZES)} + r.e + 1)', 'most > 0 and r.score <= most')})"
    return found.withColumn(spans, F.array_sort(F.concat(base, F.expr(f"transform({good}, r -> named_struct('start', r.start, 'kind', r.kind, 'end', r.end))"))))


def find(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with two columns more, and these columns' names: fixed spans, and all spans (start, kind, end) in order."""
    base, runs, spans = free_names(docs.columns, "base", "runs", "spans")
    found = cut(candidates(docs, base, runs))
    return _spans_of(found, base, runs, spans, cuts(found, runs, docs)).drop(runs), base, spans


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping ones once); n_chars follows the text."""
    return carried(docs, lambda own: _redacted(own, mark))


def _redacted(docs: DataFrame, mark: str) -> DataFrame:
    found, _, spans = find(docs)
    ends = F.transform(spans, lambda s: s["end"])
    # a span that begins at or behind all earlier ends gets a mark; what stands between those ends and it is kept
    fresh = F.filter(F.zip_with(spans, _reached(ends), lambda s, p: F.struct(s["start"].alias("start"), p.alias("p"))), lambda s: s["start"] >= s["p"])
    text = F.col("text").cast("string")
    kept = F.transform(fresh, lambda s: F.concat(F.substring(text, s["p"] + 1, s["start"] - s["p"]), F.lit(mark)))
    marked = F.concat(F.array_join(kept, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))
    has = F.size(spans) > 0
    out = found.withColumn("text", F.when(has, marked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    found = cut(candidates(docs, "base", "runs").drop("text"))
    found = _spans_of(found, "base", "runs", "spans", cuts(found, "runs", docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_name(F.col("base")), 256).alias("base_sha256"),
        _name(F.col("spans")).alias("spans"),
    )
