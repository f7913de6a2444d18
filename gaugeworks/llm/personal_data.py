"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. They are the seeds: the words
before and after them, and prefixes glued to them such as `mail=`, are lexical patterns. Other words with a digit or
`@` are candidates. Patterns and instances form a graph that is scored in rounds:

    confidence of a pattern = scores of the instances at its occurrences / occurrences of its word in the corpus
    score of an instance    = 1 for seeds, else 1 - product of (1 - confidence) over its patterns

Patterns need `support` distinct seeds, so that chance contexts do not count, and a word that mostly stands beside
ordinary words has a confidence near 0. Candidates whose score reaches `accept` are personal data of kind `other`
wherever they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The patterns as dealt. Possessive quantifiers and looking back keep the time linear: where a match exists, it
#: begins where a run of its first characters begins, or right after the match before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A whole word with a digit or an @.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CONTEXT = 64


# --- spans within a text --------------------------------------------------------------------------------


def running(values: Column, add, block: int = 64) -> Column:
    """array<int>: the first 1, 2, ... values put together by `add` (a sum, a maximum) from 0 on.

    By blocks of blocks, so that long arrays cost little more than their length.
    """
    # Bound as a lambda's argument: else the values are computed anew for every element.
    return F.get(F.transform(F.array(values), lambda own: _running(own, add, block)), 0)


def _running(values: Column, add, block: int) -> Column:
    zero = F.lit(0)
    count = lambda n: F.sequence(zero, F.expr("0") + F.floor((n - 1) / block).cast("int"))
    whole = lambda own: F.transform(count(F.size(own)), lambda k: F.aggregate(F.slice(own, k * block + 1, F.lit(block)), zero, add))
    first = lambda own, n: F.aggregate(F.slice(own, F.lit(1), n), zero, add)
    # Totals of all blocks of 64 before the block of an index, from totals of 64 such blocks and the few that are left.
    ahead = lambda one, two, k: add(
        first(two, F.floor(k / block).cast("int")),
        F.aggregate(F.slice(one, (F.floor(k / block) * block + 1).cast("int"), (k % block).cast("int")), zero, add),
    )
    bound = F.transform(F.array(whole(values)), lambda one: F.transform(F.array(whole(one)), lambda two: F.transform(
        F.array(F.transform(one, lambda _, k: ahead(one, two, k))), lambda before: F.transform(
            values,
            lambda _, i: add(
                F.get(before, F.floor(i / block).cast("int")),
                F.aggregate(F.slice(values, (F.floor(i / block) * block + 1).cast("int"), (i % block + 1).cast("int")), zero, add),
            ),
        ))))
    return F.when(F.size(values) > 0, F.get(F.get(F.get(bound, 0), 0), 0)).otherwise(F.array().cast("array<int>"))


def running_sum(values: Column) -> Column:
    return running(values, lambda total, x: total + x)


def running_max(values: Column) -> Column:
    return running(values, lambda total, x: F.greatest(total, x))


#: Code points of a chunk. Reading at a place of a string takes time in proportion to the place; in an array of chunks not.
CHUNK = 256


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(own: Column, start: Column, length: Column) -> Column:
    """`length` code points from `start` (0-based) of a text given as its chunks."""
    first = F.floor(start / CHUNK).cast("int")
    few = F.slice(own, first + 1, F.greatest(F.floor((start + length) / CHUNK).cast("int") - first + 1, F.lit(0)))
    return F.substring(F.array_join(few, ""), start - first * CHUNK + 1, length)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, in code points, end exclusive."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.transform(F.array(F.struct(found.alias("found"), gaps.alias("gaps"))), lambda x: F.struct(
        x["found"].alias("found"),
        running_sum(F.transform(x["found"], lambda m, i: F.length(m) + F.length(F.get(x["gaps"], i)))).alias("ends"),
    ))
    out = F.transform(steps, lambda x: F.transform(x["found"], lambda m, i: F.struct(
        (F.get(x["ends"], i) - F.length(m)).alias("start"), F.get(x["ends"], i).alias("end"), m.alias("value"))))
    return F.get(out, 0)


NO_SPANS = "array<struct<start:int,end:int,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def small_parts(value: Column) -> Column:
    """Whether all numbers of a dotted quad are at most 255."""
    return F.forall(
        F.split(value, r"\."),
        lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]?[0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"),
    )


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right doubled, less 9 if above 9."""
    digit = lambda i: F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), F.length(number) - 1), F.lit(0),
        lambda s, i: s + F.when(i % 2 == 0, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i)),
    )
    return total % 10 == 0


def named(kind: str, rank: int):
    return lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def base_spans(text: Column) -> Column:
    """array<struct<rank, kind, start, end, value>>: the seeds, by kind as listed, then start."""
    none = F.array().cast(NO_SPANS)
    kinds = [
        F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(none),
        F.when(F.contains(text, F.lit(".")), F.filter(spans(text, IP), lambda s: small_parts(s["value"]))).otherwise(none),
        F.filter(spans(text, CARD), lambda s: luhn(digits(s["value"]))),
        F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE), lambda s: F.length(digits(s["value"])).between(8, 15))).otherwise(none),
    ]
    return F.concat(*[F.transform(own, named(KINDS[i], i)) for i, own in enumerate(kinds)])


def before(own: Column, start: Column) -> Column:
    """The word that ends before `start`, marked if it is glued to it; '' at the text's beginning."""
    near = part(own, F.greatest(F.lit(0), start - CONTEXT), F.least(F.lit(CONTEXT), start))
    word = F.regexp_extract(near, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    return F.lower(F.concat(word, F.when(near.rlike(r"[^\x20\x09-\x0D]$"), F.lit("~")).otherwise(F.lit(""))))


def after(own: Column, end: Column) -> Column:
    near = part(own, end, F.lit(CONTEXT))
    return F.lower(F.regexp_extract(near, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1))


def in_context(own: Column, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        before(own, s["start"]).alias("left"), after(own, s["end"]).alias("right")))


def below(sorted_values: Column, value: Column) -> Column:
    """How many of sorted integers are less than `value`, by halving."""
    return F.aggregate(
        F.sequence(F.lit(30), F.lit(0), F.lit(-1)), F.lit(0),
        lambda n, k: F.when(F.get(sorted_values, n + F.call_function("shiftleft", F.lit(1), k) - 1) < value, n + F.call_function("shiftleft", F.lit(1), k)).otherwise(n),
    )


def candidate_spans(text: Column, starts: Column, reach: Column) -> Column:
    """Words with a digit or an @ that touch no base span, without a glued prefix and closing punctuation.

    `starts` are the base spans' beginnings, sorted, and `reach` the running maximum of their ends.
    """
    words = F.when(text.rlike("[0-9@]"), spans(text, CANDIDATE)).otherwise(F.array().cast(NO_SPANS))
    prefix = lambda w: F.length(F.regexp_extract(w, r"""^([^0-9@]*[=:"'(\[<])""", 1))
    value = lambda w: F.regexp_replace(F.substring(w, prefix(w) + 1, F.length(w)), r"""[.,;:!?"')\]>]+$""", "")
    cut = F.transform(words, lambda s: F.struct(
        (s["start"] + prefix(s["value"])).alias("start"),
        (s["start"] + prefix(s["value"]) + F.length(value(s["value"]))).alias("end"), value(s["value"]).alias("value")))
    # A span overlaps if one of those that begin before the candidate's end reaches beyond its beginning.
    apart = F.filter(cut, lambda s: F.coalesce(F.get(reach, below(starts, s["end"]) - 1), F.lit(0)) <= s["start"])
    return F.filter(apart, lambda s: (F.length(s["value"]) >= 4) & s["value"].rlike("[0-9@]"))


# --- the graph ------------------------------------------------------------------------------------------


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def found_in(source: DataFrame) -> DataFrame:
    """(id, text_key, base, seeds, candidates) of every row, without the text."""
    based = source.withColumn("base", base_spans(F.col("text")))
    text, base = F.col("text"), F.col("base")
    ordered = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    # Bound as lambdas' arguments, so that they are computed once for a text.
    bound = F.transform(F.array(F.struct(chunks(text).alias("own"), ordered.alias("sorted"))), lambda x: F.struct(
        in_context(x["own"], base).alias("seeds"),
        F.get(F.transform(F.array(F.struct(x["sorted"]["start"].alias("starts"), running_max(x["sorted"]["end"]).alias("reach"))), lambda y: in_context(
            x["own"], candidate_spans(text, y["starts"], y["reach"]))), 0).alias("candidates")))
    return based.select("id", "text_key", "base", F.get(bound, 0).alias("b")).select("id", "text_key", "base", "b.seeds", "b.candidates")


def edges(found: DataFrame, column: str) -> DataFrame:
    """(side, word, value, n): how often an instance stands beside a word."""
    one = found.select(F.explode(column).alias("s")).select("s.value", F.explode(F.array(
        F.struct(F.lit("L").alias("side"), F.col("s.left").alias("word")),
        F.struct(F.lit("R").alias("side"), F.col("s.right").alias("word")))).alias("p"))
    return one.where("p.word <> ''").groupBy("p.side", "p.word", "value").agg(F.count(F.lit(1)).alias("n"))


def accepted_values(source: DataFrame, found: DataFrame, support: int, accept: float, rounds: int) -> DataFrame:
    """(value): the candidates that the graph accepts."""
    seeds, others = written(edges(found, "seeds"), "seeds"), written(edges(found, "candidates"), "candidates")
    patterns = written(
        seeds.groupBy("side", "word").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("seeded"))
        .where(F.col("values") >= support).drop("values"), "patterns",
    )
    others = written(others.join(patterns.select("side", "word"), ["side", "word"]), "beside")
    empty = others.select("value").limit(0)
    if others.isEmpty():
        return empty
    counts = written(
        source.select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("total"))
        .join(patterns.select("word").distinct(), "word"), "words",
    )
    # A glued prefix is no word of its own: it occurs as often as it stands before an instance.
    glued = others.groupBy("side", "word").agg(F.sum("n").alias("beside"))
    totals = written(
        patterns.join(counts, "word", "left").join(glued, ["side", "word"], "left")
        .withColumn("total", F.greatest(F.coalesce("total", F.lit(0)), F.col("seeded") + F.coalesce("beside", F.lit(0)))).drop("beside"),
        "totals",
    )
    scores = others.select("value").distinct().withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        gained = others.join(scores, "value").groupBy("side", "word").agg(F.sum(F.col("n") * F.col("score")).alias("gained"))
        sure = totals.join(gained, ["side", "word"], "left").select(
            "side", "word", F.least(F.lit(1.0), (F.col("seeded") + F.coalesce("gained", F.lit(0.0))) / F.col("total")).alias("confidence")
        )
        doubt = F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999))))
        scores = written(others.join(sure, ["side", "word"]).groupBy("value").agg((1.0 - F.exp(doubt)).alias("score")), "scores")
    return scores.where(F.col("score") >= accept).select("value")


def discovered(docs: DataFrame, id_column: str, text_column: str, support: int, accept: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The table of `found_in`, and (id, text_key, others): spans of accepted values, in rows that have any."""
    source = keyed(docs, id_column, text_column)
    found = written(found_in(source), "found")
    values = written(accepted_values(source, found, support, accept, rounds), "accepted")
    places = found.select("id", "text_key", F.explode("candidates").alias("s")).select("id", "text_key", "s.start", "s.end", "s.value")
    others = places.join(values, "value").groupBy("id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("others"))
    return found, written(others, "others").withColumnsRenamed({"id": "other_id", "text_key": "other_key"})


def beside(rows: DataFrame, others: DataFrame) -> DataFrame:
    """`rows` (id, text_key, ...) with their `others`, an empty array where there are none."""
    equal = (F.col("text_key") == F.col("other_key")) & F.col("id").eqNullSafe(F.col("other_id"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.join(others, equal, "left").withColumn("others", F.coalesce("others", none)).drop("other_id", "other_key")


def personal_spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: int = 3, accept: float = 0.8, rounds: int = 3,
) -> DataFrame:
    """(id, base, others) for every row of `docs`: base spans (rank, kind, start, end, value) and accepted ones (start, end).

    Positions count code points, ends are exclusive. A null or empty text has no spans. Rows with equal ids, equal
    rows and null ids are separate rows and all come back. Other columns are ignored.
    """
    found, others = discovered(docs, id_column, text_column, support, accept, rounds)
    return beside(found.select("id", "text_key", "base"), others).select(F.col("id").alias(id_column), "base", "others")


def joined_spans(cuts: Column) -> Column:
    """Sorted spans (start, end, kind) with overlapping ones as one, of the first one's kind.

    A span that begins where all before it have ended begins a new one, which ends where the last one before the next
    beginning reaches to.
    """
    def of(x: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(x["cuts"]) - 1),
            lambda i: (i == 0) | (F.get(x["cuts"], i)["start"] >= F.get(x["reach"], i - 1)),
        )
        return F.get(F.transform(F.array(heads), lambda own: F.transform(own, lambda h, k: F.struct(
            F.get(x["cuts"], h)["start"].alias("start"),
            F.get(x["reach"], F.coalesce(F.get(own, k + 1), F.size(x["cuts"])) - 1).alias("end"),
            F.get(x["cuts"], h)["kind"].alias("kind")))), 0)

    bound = F.array(F.struct(cuts.alias("cuts"), running_max(F.transform(cuts, lambda s: s["end"])).alias("reach")))
    return F.get(F.transform(bound, of), 0)


def redacted(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: int = 3, accept: float = 0.8, rounds: int = 3,
) -> DataFrame:
    """`docs` with every span of personal data replaced by its kind in brackets; overlapping spans become one.

    Null texts stay null; rows and other columns stay as they are.
    """
    _, others = discovered(docs, id_column, text_column, support, accept, rounds)
    # The rest of a row travels as one struct, so that its names cannot clash with the helper columns.
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col(f"row.`{id_column}`").alias("id"), F.xxhash64(f"row.`{text_column}`").alias("text_key"))
    rows = beside(rows, others)
    text = F.col(f"row.`{text_column}`")
    cuts = F.array_sort(F.concat(
        F.transform(base_spans(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))),
        F.transform("others", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("OTHER").alias("kind")))))
    rows = rows.withColumn("cuts", F.when(text.isNotNull(), cuts))
    rows = rows.withColumn("cuts", F.when(F.size("cuts") > 0, joined_spans(F.col("cuts"))))
    begin = lambda i: F.when(i > 0, F.get("cuts", i - 1)["end"]).otherwise(F.lit(0))
    pieces = lambda own: F.transform(
        "cuts", lambda s, i: F.concat(part(own, begin(i), s["start"] - begin(i)), F.lit("["), s["kind"], F.lit("]"))
    )
    end = F.element_at("cuts", -1)["end"]
    changed = F.transform(F.array(chunks(text)), lambda own: F.concat(F.array_join(pieces(own), ""), part(own, end, F.length(text) - end)))
    changed = F.when(F.size("cuts") > 0, F.get(changed, 0)).otherwise(text)
    return rows.withColumn("changed", changed).select(*[F.col("changed").alias(c) if c == text_column else F.col(f"row.`{c}`") for c in docs.columns])


def span_digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans' text form, and all spans in that form."""
    form = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform("base", form), ",")
    other = F.transform("others", lambda s: F.concat_ws(":", F.lit("other"), s["start"].cast("string"), s["end"].cast("string")))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        id_column, *counts, F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(F.transform("base", form), other), ",").alias("spans"), F.size("others").cast("long").alias("n_other"),
    )
