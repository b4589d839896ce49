"""Topic labels: keywords, prompts, an extractive stand-in for a language model, and the normal form of its answers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut, squeeze, word_limit

#: The directions and the fields of an answer; the limits and defaults in ``normalize`` are fixed as well.
DIRECTIONS = ["positive", "negative", "none", "unclear"]
ANSWER = "refined_title string, most_relevant_search_topic string, cluster_summary string, factor_associations array<struct<factor:string,outcome_or_result:string,direction:string,brief_evidence:string>>, link_text string, tags array<string>, confidence string, specificity_score string"


def keywords(words: Column | None, top_n: Column | None, name: Column, n: int = 15) -> Column:
    """The first that is not empty: the representation's words, 'word: weight' parts, the words of the name."""
    tidy = lambda a: F.filter(F.transform(a, squeeze), lambda w: w != "")
    options = []
    if words is not None:
        options.append(tidy(words))
    if top_n is not None:
        options.append(tidy(F.transform(F.split(top_n, ","), lambda c: F.split(c, ":")[0])))
    options.append(tidy(F.split(squeeze(name), " ")))
    out = F.array().cast("array<string>")
    for o in reversed(options):
        out = F.when(F.size(F.coalesce(o, F.array().cast("array<string>"))) > 0, o).otherwise(out)
    return F.slice(out, 1, n)


def prompt(words: Column, texts: Column, chars: int = 900) -> Column:
    """Keywords in a line and the texts, squeezed and cut, as a bulleted list."""
    return F.concat(F.lit("Keywords: "), F.array_join(words, ", "), F.lit("\nDocuments:\n"), F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), cut(t, chars))), "\n"))


def extract_json(answer: Column) -> Column:
    """What stands between json tags, else from the first brace to the one that closes it, else the whole."""
    tagged = F.regexp_extract(answer, r"(?is)<json>(.*?)</json>", 1)
    ends = F.split(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), r"(?<=\})")  # pieces that end with a closing brace
    opened = lambda t: F.length(t) - F.length(F.replace(t, F.lit("{")))
    closed = lambda t: F.length(t) - F.length(F.replace(t, F.lit("}")))
    nothing = F.struct(F.lit("").alias("t"), F.lit(False).alias("done"))
    taken = F.aggregate(ends, nothing, lambda s, p: F.when(s["done"], s).otherwise(F.struct(F.concat(s["t"], p).alias("t"), ((opened(F.concat(s["t"], p)) == closed(F.concat(s["t"], p))) & (closed(p) > 0)).alias("done"))))
    braced = F.when(taken["done"], taken["t"]).otherwise("")
    return squeeze(F.when(tagged != "", tagged).when(braced != "", braced).otherwise(answer))


def repair_json(body: Column) -> Column:
    """``body`` if it can be read; else with straight quotes, without commas before a closing bracket, and with the brackets closed that a cut-off answer left open.

    A text cut off within a string gets its quote first. Brackets within strings are not told from others: what still cannot be read gives the defaults.
    """
    t = F.regexp_replace(F.translate(body, "\u201c\u201d\u201e", '"""'), r"[,:\s]+$", "")
    marks = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c)))
    t = F.when(marks(F.replace(t, F.lit('\\"')), '"') % 2 == 1, F.concat(t, F.lit('"'))).otherwise(t)
    # closers in the order in which the brackets that stay open were opened
    signs = F.split(F.regexp_replace(F.regexp_replace(t, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", ""), "")
    opened = F.aggregate(signs, F.lit(""), lambda s, c: F.when(c == "{", F.concat(F.lit("}"), s)).when(c == "[", F.concat(F.lit("]"), s)).when(c.isin("}", "]"), F.substr(s, F.lit(2))).otherwise(s))
    t = F.regexp_replace(F.concat(t, opened), r",(?=\s*[}\]])", "")
    return F.when(F.try_parse_json(body).isNull() & body.rlike(r"^\s*\{"), t).otherwise(body)


def score_1_5(value: Column, whole_only: Column) -> Column:
    """A score clamped to 1..5, 3 if it is none; decimals are cut, or where ``whole_only`` (a score written as a string) count as none."""
    v = squeeze(value)
    number = F.when(v.rlike(r"^[+-]?[0-9]+$") | (~whole_only & v.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")), v.cast("double").cast("int"))
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(number, F.lit(3))))


def normalize(df: DataFrame, answer: str, version: int = 1) -> DataFrame:
    """The columns of a label from a model's answer, with its defaults and limits; what cannot be read gives the defaults."""
    body = repair_json(extract_json(F.col(answer)))
    a = F.from_json(body, ANSWER)
    quoted = lambda f: F.coalesce(body.rlike(rf'"{f}"\s*:\s*"'), F.lit(False)) if version == 1 else F.lit(True)
    listed = F.coalesce(a["tags"], F.split(F.from_json(body, "tags string")["tags"], ","))
    text = lambda f, n, default="": F.substring(squeeze(F.coalesce(a[f], F.lit(default))), 1, n)
    direction = lambda x: F.when(F.lower(squeeze(x)).isin(DIRECTIONS), F.lower(squeeze(x))).otherwise("unclear")
    side, proof = (1_000_000, 160) if version == 1 else (200, 300)
    links = F.transform(
        F.slice(F.coalesce(a["factor_associations"], F.array().cast("array<struct<factor:string,outcome_or_result:string,direction:string,brief_evidence:string>>")), 1, 8),
        lambda x: F.struct(F.substring(squeeze(F.coalesce(x["factor"], F.lit(""))), 1, side).alias("factor"), F.substring(squeeze(F.coalesce(x["outcome_or_result"], F.lit(""))), 1, side).alias("outcome_or_result"), direction(x["direction"]).alias("direction"), F.substring(squeeze(F.coalesce(x["brief_evidence"], F.lit(""))), 1, proof).alias("brief_evidence")),
    )
    tags = F.slice(F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda t: F.lower(squeeze(t))), lambda t: t != ""), 1, 10)
    out = df.withColumns({
        "refined_title": text("refined_title", 100, "unlabeled-topic"), "search_topic": text("most_relevant_search_topic", 250), "summary": text("cluster_summary", 2000) if version == 1 else word_limit(F.coalesce(a["cluster_summary"], F.lit("")), 250),
        "associations_json": F.to_json(links), "associations": F.size(links), "link_text": text("link_text", 500 if version == 1 else 400), "tags": F.array_join(tags, ", "), "confidence": score_1_5(a["confidence"], quoted("confidence")),
    })
    return out.withColumn("specificity_score", score_1_5(a["specificity_score"], quoted("specificity_score"))) if version == 1 else out


def extractive_answers(topics: DataFrame, sizes: DataFrame) -> DataFrame:
    """(topic, answer): a deterministic stand-in for a generated answer, from a topic's keywords and its number of texts.

    ``topics`` has topic and words, ``sizes`` topic and n. The title is the first three keywords, the confidence grows with
    the digits of n.
    """
    w = F.col("words")
    body = F.to_json(F.struct(
        F.array_join(F.slice(w, 1, 3), " ").alias("refined_title"), F.element_at(w, 1).alias("most_relevant_search_topic"), F.concat(F.lit("About "), F.array_join(w, ", "), F.lit(".")).alias("cluster_summary"),
        F.array(F.struct(F.try_element_at(w, F.lit(2)).alias("factor"), F.element_at(w, 1).alias("outcome_or_result"), F.lit("Positive ").alias("direction"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" texts")).alias("brief_evidence"))).alias("factor_associations"),
        F.array_join(w, " ").alias("link_text"), F.transform(w, F.upper).alias("tags"), F.length(F.coalesce("n", F.lit(0)).cast("string")).cast("string").alias("confidence"), (F.length(F.coalesce("n", F.lit(0)).cast("string")) + 0.5).alias("specificity_score"),
    ))
    return topics.join(sizes, "topic", "left").select("topic", F.concat(F.lit("Here it is: <JSON> "), body, F.lit(" </JSON> Done.")).alias("answer"))


def score_histogram(labels: DataFrame, score: str) -> DataFrame:
    """(score, labels) for every score from 1 to 5."""
    every = labels.sparkSession.range(1, 6).select(F.col("id").cast("int").alias(score))
    return every.join(labels.groupBy(score).agg(F.count("*").alias("labels")), score, "left").select(score, F.coalesce("labels", F.lit(0)).alias("labels"))


def confidence_report(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count("*").alias("labels"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") >= 4).alias("confident"))
