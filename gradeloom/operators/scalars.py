"""Projections, filters and scalar functions (column in, column out unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Command verbs by family. A verb outside the lists is its own family.
VERB_FAMILIES = {
    "short-recall": ["state", "define", "identify", "name", "give", "list", "what"],
    "elaboration": ["explain", "describe", "discuss", "outline", "justify"],
    "comparative-analysis": ["compare", "evaluate", "contrast", "assess"],
    "procedural-computation": ["calculate", "convert", "show", "derive", "compute"],
    "visual-representation": ["draw", "sketch", "complete", "label"],
}
UNCATEGORIZED = "(uncategorized)"
#: The known reasons of a missed point.
REASONS = ["knowledge_gap", "misinterpretation", "insufficient_detail", "retrieval_quality"]
_CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


def where_eq(df: DataFrame, order_by=None, limit: int | None = None, **equal) -> DataFrame:
    """Rows that equal every given value, optionally ordered and cut."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    df = df.orderBy(order_by) if order_by is not None else df
    return df.limit(limit) if limit is not None else df


def by_ids(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows of the listed ids in the list's order (a repeated id repeats its row)."""
    wanted = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("position", key))
    return df.join(F.broadcast(wanted), key).orderBy("position")  # as long as the argument list


def topic_questions(qa: DataFrame, topic: str | None = None, difficulty: str | None = None, n: int = 10) -> DataFrame:
    """Per topic (or for one) the first n questions: representative, then most successes, then id."""
    if topic is not None:
        qa = qa.where(F.col("topic") == topic)
    if difficulty is not None:
        qa = qa.where(F.col("difficulty_estimate") == difficulty)
    order = W.partitionBy("topic").orderBy(F.desc("is_representative"), F.desc("success_count"), "id")
    return qa.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def by_quality(topics: DataFrame, qualities: list[str]) -> DataFrame:
    return topics.where(F.col("quality").isin(*qualities))


def topic_name(topic: Column) -> Column:
    return F.when(F.coalesce(topic, F.lit("")) == "", F.lit(UNCATEGORIZED)).otherwise(topic)


def topic_groups(qa: DataFrame) -> DataFrame:
    """Question count and least id per topic; a missing topic is one group."""
    return qa.groupBy(topic_name(F.col("topic")).alias("topic")).agg(F.count("*").alias("qa_count"), F.min("id").alias("first_id"))


def topic_texts(qa: DataFrame, n: int = 2000) -> DataFrame:
    """First n characters of each named topic's answers, joined by spaces in id order.

    Only the answers that can reach the first n characters are gathered.
    """
    order = W.partitionBy("topic").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("answer_text") + 1).over(order), F.lit(0))
    near = qa.where("topic <> ''").withColumn("before", before).where(F.col("before") < n)
    parts = F.array_sort(F.collect_list(F.struct("id", F.substring("answer_text", 1, n).alias("text"))))
    return near.groupBy("topic").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), " "), 1, n).alias("text"))


def derive_feedback(fb: DataFrame) -> DataFrame:
    """Coverage, and whether the two topics of a feedback row agree (both named, any case)."""
    points = F.col("covered_count") + F.col("missed_count")
    same = (F.lower("step0_topic") == F.lower("round2_topic")) & (F.col("step0_topic") != "")
    return fb.withColumn("coverage_ratio", F.when(points > 0, F.col("covered_count") / points).otherwise(0.0)).withColumn(
        "topic_match", F.coalesce(same, F.lit(False)).cast("int")
    )


def parse_missed(missed: Column) -> tuple[Column, Column]:
    """Missed points, an array of (point, reason), as a text of lines and a map of known reasons' counts."""
    text = F.array_join(F.transform(missed, lambda m: m["point"]), "\n")
    reasons = F.transform(missed, lambda m: m["reason"])
    counts = [F.size(reasons) - F.size(F.array_remove(reasons, reason)) for reason in REASONS]
    pairs = F.arrays_zip(F.array(*map(F.lit, REASONS)), F.array(*counts))
    return text, F.map_from_entries(F.filter(pairs, lambda p: p["1"] > 0))


def missed_lines(fb: DataFrame, qa: DataFrame) -> DataFrame:
    """One trimmed, non-empty line per row of the missed text, with the question's topic."""
    lines = fb.join(qa.select(F.col("id").alias("qa_id"), "topic"), "qa_id").select("qa_id", "topic", F.explode(F.split("missed_text", "\n")).alias("line"))
    return lines.withColumn("line", F.trim("line")).where("line <> ''")


def encode_text(question: Column, answer: Column, summary: Column) -> Column:
    """Question and answer, or the summary where both are empty."""
    both = F.trim(F.concat_ws(" ", question, answer))
    return F.when(both != "", both).otherwise(F.coalesce(summary, F.lit("")))


def detect_lang(text: Column, share: float = 0.05) -> Column:
    """'zh' if more than ``share`` of the characters are Han, else 'en'."""
    text = F.coalesce(text, F.lit(""))
    han = F.length(text) - F.length(F.regexp_replace(text, _CJK, ""))
    return F.when((F.length(text) > 0) & (han / F.greatest(F.length(text), F.lit(1)) > share), F.lit("zh")).otherwise("en")


def topic_id(topic: Column) -> Column:
    return F.concat(F.lit("topic_"), F.translate(topic, " /", "__"))


def qn_key(number: Column) -> Column:
    """Natural order of question numbers: the leading number (0 if none), then the rest."""
    digits = F.regexp_extract(number, r"^(\d+)", 1)
    return F.struct(F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("long")).alias("number"), F.regexp_replace(number, r"^\d+", "").alias("rest"))


def kp_idx(kp_id: Column) -> Column:
    """Cluster number in an id ``kp_<digits>``, whatever follows; null without one."""
    digits = F.regexp_extract(kp_id, r"^kp_(\d+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def is_bullet(line: Column) -> Column:
    """A line that starts as a list item: a dash or dot sign, a number before '.', a number before ')'
    where the line has no '.', or a bracketed mark."""
    line = F.trim(line)
    numbered = F.when(F.contains(line, F.lit(".")), line.rlike(r"^\d+\.")).otherwise(line.rlike(r"^\d+\)"))
    return line.rlike("^[-•‣]") | numbered | line.rlike(r"^\([^)]+\)")


def has_bullet(text: Column) -> Column:
    return F.exists(F.split(text, "\n"), is_bullet)


def bullet_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), is_bullet))


def normalize_text(text: Column) -> Column:
    """List marks as an indented dot, no trailing blanks, at most one blank line in a row."""

    def line(x: Column) -> Column:
        return F.rtrim(F.when(x.rlike("^[-*] "), F.concat(F.lit("  • "), F.substring(x, F.lit(3), F.length(x)))).otherwise(x))

    return F.regexp_replace(F.array_join(F.transform(F.split(text, "\n"), line), "\n"), "\n{3,}", "\n\n")


def annotate_related(points: DataFrame, links: DataFrame, related: DataFrame, least: int = 2, top: int = 3) -> DataFrame:
    """A note for each topic heading: its links (``See also``), or without any its co-topics (``Related``).

    ``points(header)``; ``links(src, dst, count)``; ``related(topic, other, count)``. A header belongs
    to the longest topic name that it starts with.
    """
    named = links.select(F.col("src").alias("topic")).union(related.select("topic")).distinct()
    heads = points.select("header").distinct()
    starts = heads.select("header", F.explode(F.transform(F.sequence(F.lit(0), F.length("header")), lambda n: F.substring(F.col("header"), F.lit(1), n))).alias("topic"))
    longest = starts.hint("shuffle_hash").join(named, "topic").groupBy("header").agg(F.max_by("topic", F.length("topic")).alias("topic"))
    of = heads.hint("merge").join(longest, "header", "left")

    def joined(rows: DataFrame, key: str, other: str, head: str, form: str) -> DataFrame:
        ranked = rows.where(F.col("count") >= least).withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc("count"), other)))
        kept = ranked if head == "see" else ranked.where(F.col("nth") <= top)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.format_string(form, *([other, "count"] if head == "see" else [other])).alias("t")))), lambda x: x["t"]), ", ")
        return kept.groupBy(F.col(key).alias("topic")).agg(text.alias(head))

    see = joined(links, "src", "dst", "see", "%s (ref %d)")
    rel = joined(related, "topic", "other", "rel", "%s")
    note = F.coalesce(F.concat(F.lit("See also: "), "see"), F.concat(F.lit("Related: "), "rel"))
    return of.join(see, "topic", "left").join(rel, "topic", "left").select("header", "topic", note.alias("note"))


def transition_weight(count: Column) -> Column:
    return F.least(count / 10, F.lit(1.0))


def key_terms(text: Column) -> Column:
    """Distinct capitalised words of three letters or more, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Za-z]{2,}\b"), F.lit(0))))


def verb_family(verb: Column) -> Column:
    families = F.create_map(*(F.lit(x) for family, verbs in VERB_FAMILIES.items() for v in verbs for x in (v, family)))
    return F.coalesce(families[F.lower(verb)], F.lower(verb))


# Ranges and binary digits of generated numbers by difficulty; all other difficulties count as the last.
BINARY_RANGES = {"basic": (1, 15, 4), "intermediate": (16, 255, 8), "advanced": (256, 65535, 16)}
HEX_RANGE = (1, 255)
DECIMAL_RANGES = {"basic": (1, 100), "advanced": (100, 10000)}


def render_variations(templates: DataFrame, n: int = 3, difficulty: str = "basic", seed: int = 0) -> DataFrame:
    """n variations of ``template`` with each ``{name}`` of ``params(name, type, example)`` replaced by a
    seeded value of its type: binary, hexadecimal or decimal (denary) in the difficulty's range; a
    parameter of another type gets its example, or 0 without one."""
    low, high, digits = BINARY_RANGES.get(difficulty, BINARY_RANGES["advanced"])
    least, most = DECIMAL_RANGES.get(difficulty, DECIMAL_RANGES["advanced"])
    rows = templates.withColumn("variation", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def put(text: Column, param: Column) -> Column:
        drawn = lambda a, b: F.pmod(F.xxhash64(F.lit(seed), "template_id", "variation", param["name"]), F.lit(b - a + 1)) + a
        kind = F.lower(F.coalesce(param["type"], F.lit("")))
        value = (
            F.when(kind.contains("binary"), F.lpad(F.bin(drawn(low, high)), digits, "0"))
            .when(kind.contains("hex"), F.lpad(F.hex(drawn(*HEX_RANGE)), 2, "0"))
            .when(kind.contains("decimal") | kind.contains("denary"), drawn(least, most).cast("string"))
            .otherwise(F.coalesce(param["example"], F.lit("0")))
        )
        return F.replace(text, F.concat(F.lit("{"), param["name"], F.lit("}")), value)

    return rows.select("template_id", "variation", F.aggregate("params", F.col("template"), put).alias("question"))
