"""Personal data: base patterns, and identifiers found through the contexts that known ones share.

Base spans (email, ip, card, phone) are reported wherever they are. Then extraction is bootstrapped: base spans are
instances and seeds with score 1, however many tokens they have; tokens that carry digits or an at sign and that no base
span touches are instances too. Of a token only the value counts: not brackets, quotes and stops at its edges, nor a label
that ends in = or : (which belongs to the words before). The two words before an occurrence are a pattern, and so are
the two words after it; other matches and tokens are holes in words before, and not allowed in words after. If one word stands between it and the start of its
line or text, a label, that is a pattern of its own as well.
Pattern and instance scores are computed in turn over the graph of distinct (pattern, instance) pairs, ROUNDS times: a
pattern scores what its instances' scores sum to, over that, DOUBT times what they lack and SHRINK; an instance scores 1 - product of (1 - score) over its
patterns with enough confidence. Unseen instances over FOUND next to a pattern over CONFIDENT are reported as spans of
the kind `context`. Pairs are counted before anything is gathered, so a very common pattern or instance is a row a task.
What patterns and instances say goes back to their occurrences by a broadcast where it is small; else each of their rows
is laid out SALTS times and occurrences are spread over them, so no task gets all occurrences of a common pattern.

Null texts count as empty. Rows that repeat get the same result, and count once as evidence. Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weighbridge.llm import common, spans

#: Runs are possessive and start where a run starts or the last match ended: the same matches, found in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SMALL = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
KINDS = ("email", "ip", "card", "phone", "context")
TOKEN = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
#: So many code points beside an occurrence are read for its patterns where they hold two whole words, else all of them.
BESIDE = 96
#: What other matches and tokens are in a pattern, and what begins the patterns after an occurrence.
HOLE, AFTER = "\x01", "\x02"
#: Ways to spread the occurrences of a pattern or instance.
SALTS = 64
ROUNDS = 3
CONFIDENT = 0.6
FOUND = 0.7
SUPPORT = 3
SHRINK = 2.0
#: How much an instance of which nothing is known counts against a pattern, where a known one counts 1 for it.
DOUBT = 0.5
#: Scores are rounded, so that the order in which they are added up does not matter.
DIGITS = 9


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled, digits summed, a multiple of 10."""
    places = F.sequence(F.lit(1), F.length(value))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(value), i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, doubled(d)).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def card_like(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))


def before(gaps: Column, matches: Column) -> Column:
    """For each match the text before it, two whole words at least if there are as many; the two matches before are holes,
    and a text starts with a line break."""

    def tail(i: Column) -> Column:
        whole = F.get(gaps, i)
        near = F.right(whole, F.lit(BESIDE))
        return F.when((F.length(whole) <= BESIDE) | near.rlike(r"\s\S++\s++\S++\s*+\z"), near).otherwise(whole)

    upto = lambda i: F.when(i > 0, F.concat(F.when(i > 1, F.lit(HOLE)).otherwise(F.lit("\n")), tail(i - 1), F.lit(HOLE))).otherwise(F.lit("\n"))
    return F.transform(matches, lambda _, i: F.concat(upto(i), tail(i)))


def after(gaps: Column, matches: Column) -> Column:
    """The same of the text after each match, which ends with a line break."""

    def head(i: Column) -> Column:
        whole = F.get(gaps, i)
        near = F.left(whole, F.lit(BESIDE))
        return F.when((F.length(whole) <= BESIDE) | near.rlike(r"\A\s*+\S++\s++\S++\s"), near).otherwise(whole)

    last = F.size(matches) - 1
    on = lambda i: F.when(i < last, F.concat(F.lit(HOLE), head(i + 2), F.when(i < last - 1, F.lit(HOLE)).otherwise(F.lit("\n")))).otherwise(F.lit("\n"))
    return F.transform(matches, lambda _, i: F.concat(head(i + 1), on(i)))


def _words(context: Column) -> tuple[Column, Column]:
    """A context in lower case with tokens as holes, and its words."""
    text = F.lower(F.regexp_replace(context, r"[^\s,;&|0-9@\x01]*+[0-9@\x01][^\s,;&|]*+", HOLE))
    return text, F.filter(F.split(text, r"\s+"), lambda w: w != "")


def patterns(context: Column, beyond: Column) -> Column:
    """Before: the two words at the end of a context, and the word that is alone after a line break, which its pattern keeps.
    After: the two words at the start of what is beyond."""
    opened = F.regexp_replace(context, r"(?<![^\s])[^\s\p{L}\p{N}\x01]++\z", "")  # brackets and quotes that touch the occurrence
    text, words = _words(opened)
    two = F.when(F.size(words) >= 2, F.array_join(F.slice(words, -2, 2), " "))
    alone = F.regexp_extract(text, r"\n[^\S\n]*+(\S++)[^\S\n]*+\z", 1)
    closed = F.regexp_replace(beyond, r"\A[^\s\p{L}\p{N}\x01]++(?![^\s])", "")
    behind = _words(closed)[1]
    near = F.array_join(F.slice(behind, 1, 2), " ")
    two_behind = F.when((F.size(behind) >= 2) & ~F.contains(near, F.lit(HOLE)), F.concat(F.lit(AFTER), near))
    return F.array_compact(F.array(two, F.when(alone != "", F.concat(F.lit("\n"), alone)), two_behind))


#: A label within a token, and what else its value is not.
LABEL, LEAD, TRAIL = r"^[^\s0-9@]*[=:]", r"^[^A-Za-z0-9+@]+", r"[^A-Za-z0-9]+$"


def value_of(token: Column) -> Column:
    """A token's value within it: the text before it that belongs to the context, its start, and itself."""
    label = F.regexp_extract(token, LABEL, 0)
    rest = F.substring(token, F.length(label) + 1, F.length(token))
    lead = F.length(F.regexp_extract(rest, LEAD, 0))
    own = F.regexp_replace(F.substring(rest, lead + 1, F.length(rest)), TRAIL, "")
    return F.struct(label.alias("label"), (F.length(label) + lead).cast("long").alias("skip"), own.alias("own"))


def evidence(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: its key, a mark of its text, base spans, and all instances with their patterns; the text is left behind."""
    text_of = F.coalesce(F.col(text), F.lit(""))
    raw = docs.select(F.col(key).alias("id"), F.xxhash64(text_of).alias("mark"), text_of.alias("t"))
    t = F.col("t")
    has_digit = t.rlike("[0-9]")
    kinds = {"email": (EMAIL, F.contains(t, F.lit("@"))), "ip": (IP, t.rlike(r"[0-9]\.[0-9]")), "card": (CARD, has_digit), "phone": (PHONE, F.contains(t, F.lit("+"))), "token": (TOKEN, has_digit | F.contains(t, F.lit("@")))}
    cut = {k: spans.found(t, p, guard) for k, (p, guard) in kinds.items()}
    raw = raw.select("id", "mark", *(x.alias(f"{k}_{n}") for k, pair in cut.items() for n, x in zip("gm", pair, strict=True)))


    def context(k: str) -> Column:
        gaps, matches = F.col(f"{k}_g"), F.col(f"{k}_m")
        beside = F.arrays_zip(before(gaps, matches).alias("before"), after(gaps, matches).alias("after"))
        return F.zip_with(spans.places(gaps, matches), beside, lambda s, b: s.withField("before", b["before"]).withField("after", b["after"]))

    placed = raw.select("id", "mark", *(context(k).alias(k) for k in kinds))
    candidate = lambda s: (F.length(digits(s["value"])) >= 4) | F.contains(value_of(s["value"])["own"], F.lit("@"))
    tests = {"email": None, "ip": lambda s: s["value"].rlike(SMALL), "card": lambda s: card_like(s["value"]), "phone": lambda s: F.length(digits(s["value"])).between(9, 15), "token": candidate}
    kept = placed.select("id", "mark", *((F.col(k) if f is None else F.filter(F.col(k), f)).alias(k) for k, f in tests.items()))
    base = F.array_sort(F.concat(*(spans.tagged(F.col(k), k, n) for n, k in enumerate(KINDS[:4]))))

    def instance(s: Column, seed: bool) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("instance"), patterns(s["before"], s["after"]).alias("patterns"), F.lit(seed).alias("seed"))

    def inner(s: Column) -> Column:
        """The token's value in its place; what is cut off at its edges belongs to the texts beside it, as far as words go."""
        v = value_of(s["value"])
        start = s["start"] + v["skip"]
        moved = s.withField("start", start).withField("end", start + F.length(v["own"])).withField("value", v["own"])
        return moved.withField("before", F.concat(s["before"], v["label"]))

    every = [F.transform(F.col(k), lambda s: instance(s, True)) for k in KINDS[:4]]
    every.append(F.transform(F.transform(F.col("token"), inner), lambda s: instance(s, False)))
    return kept.select("id", "mark", base.alias("base"), F.concat(*every).alias("tokens"))


def occurrences(found: DataFrame) -> DataFrame:
    """Seeds, and tokens that no seed touches, of each (id, mark): start, end, instance, patterns, seed."""
    laid = found.where(F.size("tokens") > 0).dropDuplicates(["id", "mark"]).select("id", "mark", F.inline("tokens"))
    own = Window.partitionBy("id", "mark")
    behind = F.max(F.when(F.col("seed"), F.col("end"))).over(own.orderBy("start"))
    ahead = F.min(F.when(F.col("seed"), F.col("start"))).over(own.orderBy(F.desc("start")))
    touched = F.coalesce(behind > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    return laid.withColumn("touched", touched).where(F.col("seed") | ~F.col("touched")).drop("touched")


def met(rows: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """rows joined to few, a written table of distinct strings `on`, so that no task gets all rows of a common one."""
    longest = few.agg(F.coalesce(F.max(F.octet_length(on)), F.lit(0))).first()[0]
    sent = common.small(few, 64 + longest)
    if sent is not few:
        return rows.join(sent, on)
    laid = few.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(laid, [on, "_s"]).drop("_s")


def scored(graph: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """graph(pattern, instance, seed) to the patterns with enough confidence and support, and every instance's score."""
    scores = graph.groupBy("instance").agg(F.max("seed").alias("seed"), F.max("seed").alias("score"))
    for _ in range(rounds):
        by = graph.drop("seed").join(scores, "instance").groupBy("pattern").agg(F.round(F.sum("score") / (F.sum("score") + DOUBT * (F.count("*") - F.sum("score")) + SHRINK), DIGITS).alias("confidence"), F.sum("seed").alias("support"))
        patterns = common.written(by.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)), "patterns")
        missed = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        lifted = met(graph.drop("seed"), patterns, "pattern").groupBy("instance").agg((1 - missed).alias("lifted"))
        own = graph.groupBy("instance").agg(F.max("seed").alias("seed")).join(lifted, "instance", "left")
        scores = common.written(own.select("instance", "seed", F.round(F.greatest("seed", F.coalesce("lifted", F.lit(0.0))), DIGITS).alias("score")), "scores")
    return patterns, scores


def discover(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The tokens of each (id, mark) that high-confidence patterns and instances name."""
    laid = common.written(occurrences(found).withColumn("pattern", F.explode("patterns")).drop("patterns"), "occurrences")
    graph = common.written(laid.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")), "graph")
    patterns, scores = scored(graph, rounds)
    unseen = common.written(scores.where((F.col("score") >= FOUND) & (F.col("seed") == 0)).select("instance"), "unseen")
    good = met(met(laid.where(~F.col("seed")), patterns.select("pattern"), "pattern"), unseen, "instance")
    span = F.struct(F.col("start"), F.lit(4).alias("kind_no"), F.col("end"), F.lit("context").alias("kind"))
    return good.groupBy("id", "mark").agg(F.collect_set(span).alias("more"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its key, the mark of its text, base and spans, each array<struct<start, kind_no, end, kind>>.
    A discovered span that a base span overlaps is left to the base span."""
    found = common.written(evidence(docs, key, text), "personal")
    more = discover(found).select(F.col("id").alias("i"), F.col("mark").alias("m"), "more")
    out = found.select("id", "mark", "base").join(more, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    free = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", free)))
    return out.select(F.col("id").alias(key), "mark", "base", every.alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; overlapping spans by the first's.
    count, where docs has it, is the length of the new text; a null text stays null."""
    given = docs.columns
    docs, (key, text, count) = common.apart(docs, key, text, count)
    found = find(docs, key, text).where(F.size("spans") > 0).dropDuplicates([key, "mark"])
    found = found.select(F.col(key).alias("_i"), F.col("mark").alias("_m"), F.col("spans").alias("_s"))
    empty = F.struct(F.lit(0).cast("long").alias("end"), F.expr("cast(array() as array<struct<start: bigint, kind_no: int, end: bigint, kind: string>>)").alias("out"))

    def merge(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["end"]
        last = F.element_at(acc["out"], -1)
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(last.withField("end", F.greatest(last["end"], s["end"]))))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.when(inside, longer).otherwise(F.concat(acc["out"], F.array(s))).alias("out"))

    merged = F.aggregate("_s", empty, merge, lambda acc: acc["out"])
    found = common.written(found.withColumn("_s", merged), "spans")
    longest = found.agg(F.coalesce(F.max(F.size("_s")), F.lit(0))).first()[0]
    joined = docs.join(common.small(found, 48 * longest + 64), docs[key].eqNullSafe(F.col("_i")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_m")), "left")
    t = docs[text]
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_s", lambda s: s["end"]))
    pieces = F.zip_with(starts, "_s", lambda a, s: F.when(s.isNull(), F.substring(t, (a + 1).cast("int"), F.length(t))).otherwise(F.concat(F.substring(t, (a + 1).cast("int"), (s["start"] - a).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
    new = F.when(F.col("_s").isNull(), t).otherwise(F.array_join(pieces, ""))
    names = docs.columns
    out = joined.select(*(docs[c] for c in names if c not in (text, count)), new.alias(text))
    if count in names:
        out = out.withColumn(count, F.coalesce(F.length(text).cast(docs.schema[count].dataType), F.lit(0).cast(docs.schema[count].dataType)))
    return out.select(*names).toDF(*given)


def query(spark, sf_dir: str) -> DataFrame:
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = [spans.how_many(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]]
    return out.select("doc_id", *n, F.sha2(spans.listed(F.col("base")), 256).alias("base_sha256"), spans.listed(F.col("spans")).alias("spans"))
