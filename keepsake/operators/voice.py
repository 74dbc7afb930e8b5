"""Writing style of an owner.

All rates come from one pass that adds up per-text counts; phrase lists are counted and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.lexicons import (
    CONJUNCTIONS, CONTRACTIONS, HUMOUR, SERIOUS, SLANG, STYLE_STOP_WORDS,
)
from keepsake.functions.text import (
    EMOJI, any_word, bounded, clamp01, count_matches, ngrams, one_line, sentences,
    strip, tokens, word_count,
)
from keepsake.operators.ranking import MAX_OWNERS, broadcast_if_small, top_counts, top_k
from keepsake.operators.term_index import stored

# Frequent pairs of words: a million of them are some tens of megabytes.
MAX_PAIRS = 1_000_000

# What each mark is.
MARKS = {
    "exclamations": "!", "questions": r"\?", "ellipses": r"\.\.\.", "em_dashes": "—|--",
    "parentheticals": r"\([^)]*\)", "quotes": '["“”]',
}
PASSION = bounded(r"\*[^*]+\*|\b[A-Z]{3,}\b")
COMPLEX = "(?i),|;|" + any_word(CONJUNCTIONS).removeprefix("(?i)")


def style_corpus(texts: DataFrame, body: str = "body", min_words: int = 5) -> DataFrame:
    """Texts long enough to show a style, without the placeholders of removed ones."""
    trimmed = texts.withColumn("body", strip(F.coalesce(body, F.lit(""))))
    low = F.lower("body")
    return (
        trimmed.withColumn("words", word_count("body"))
        .filter((F.col("words") >= min_words) & ~low.isin("[deleted]", "[removed]"))
    )


def with_style_counts(corpus: DataFrame) -> DataFrame:
    """Per-text counts behind every rate."""
    pieces = sentences("body")
    per_sentence = F.transform(F.col("pieces"), word_count)
    paragraphs = F.size(F.filter(F.split("body", r"\n\n+"), lambda p: p != ""))
    return (
        corpus.select("owner_id", "body", "words")
        .withColumn("pieces", pieces)
        .select(
            "owner_id", "words",
            (count_matches("body", any_word(CONTRACTIONS))
             + count_matches("body", any_word(SLANG))).alias("casual_hits"),
            F.col("body").rlike("^[A-Z]").cast("long").alias("capital_start"),
            count_matches("body", any_word(HUMOUR)).alias("humour_hits"),
            count_matches("body", any_word(SERIOUS)).alias("serious_hits"),
            count_matches("body", PASSION).alias("passion_hits"),
            *[count_matches("body", p).alias(name) for name, p in MARKS.items()],
            F.size("pieces").cast("long").alias("sentence_count"),
            F.aggregate(per_sentence, F.lit(0).cast("long"), lambda a, n: a + n)
            .alias("sentence_words"),
            F.size(F.filter(per_sentence, lambda n: n > 0)).cast("long").alias("worded_sentences"),
            F.size(F.filter("pieces", lambda s: s.rlike(COMPLEX))).cast("long")
            .alias("complex_sentences"),
            F.greatest(F.lit(1), paragraphs).cast("long").alias("paragraphs"),
            F.size(F.filter(tokens("body"), lambda w: F.length(w) >= 9)).cast("long")
            .alias("long_words"),
        )
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def style_numbers(corpus: DataFrame) -> DataFrame:
    """One row per owner: lengths, tone, punctuation, sentence structure, vocabulary."""
    n, words = F.count(F.lit(1)), F.sum("words")
    long_ratio = _ratio(F.sum("long_words"), words)
    vocabulary = (F.when(long_ratio > 0.18, "technical").when(long_ratio > 0.12, "advanced")
                  .when(long_ratio > 0.08, "moderate").otherwise("simple"))
    return with_style_counts(corpus).groupBy("owner_id").agg(
        n.alias("texts"), words.alias("total_words"),
        _ratio(words, n).alias("avg_length"),
        # Exact: partial states hold a count per distinct word count.
        F.percentile("words", F.lit(0.5)).alias("median_length"),
        _ratio(F.count_if(F.col("words") < 20), n).alias("short_share"),
        _ratio(F.count_if(F.col("words") > 100), n).alias("long_share"),
        clamp01(_ratio(F.sum("casual_hits"), n * 3)).alias("casual"),
        clamp01(_ratio(F.sum("capital_start"), n)).alias("formal"),
        clamp01(_ratio(F.sum("humour_hits"), n)).alias("humorous"),
        clamp01(_ratio(F.sum("serious_hits"), n)).alias("serious"),
        clamp01(_ratio(F.sum("passion_hits"), n)).alias("passionate"),
        _ratio(F.sum("exclamations"), n).alias("exclamations_per_text"),
        _ratio(F.sum("questions"), n).alias("questions_per_text"),
        _ratio(F.sum("ellipses"), n).alias("ellipses_per_text"),
        _ratio(F.sum("em_dashes"), n).alias("em_dashes_per_text"),
        (_ratio(F.sum("parentheticals"), words) * 100).alias("parentheticals_per_100_words"),
        (_ratio(F.sum("quotes"), words) * 100).alias("quotes_per_100_words"),
        _ratio(F.sum("sentence_words"), F.sum("worded_sentences")).alias("words_per_sentence"),
        _ratio(F.sum("complex_sentences"), F.sum("sentence_count")).alias("complex_share"),
        _ratio(F.sum("paragraphs"), n).alias("paragraphs_per_text"),
        long_ratio.alias("long_word_ratio"), vocabulary.alias("vocabulary"))


def common_phrases(corpus: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent two- and three-word runs with a content word, per text."""
    w = F.col("w")
    words = stored(corpus.select("owner_id", tokens("body").alias("w")), "words")
    content = F.exists(F.split("phrase", " "), lambda p: ~p.isin(*STYLE_STOP_WORDS))

    def counted(grams: DataFrame) -> DataFrame:
        return grams.groupBy("owner_id", "phrase").agg(F.count(F.lit(1)).alias("count"))

    # Counting first leaves one test per distinct phrase instead of one per occurrence.
    pairs = stored(counted(words.select("owner_id", F.explode(ngrams(w, 2)).alias("phrase"))), "pairs")
    order = [F.desc("count"), F.asc("phrase")]
    best = stored(top_k(pairs.filter(content), ["owner_id"], order, k), "best").drop("rank")
    # Three words stand no more often than either pair of neighbours in them: only runs of pairs that are as frequent as the
    # last of the k best pairs can be among the k best phrases, so the many rare runs are neither shuffled nor counted.
    least = best.groupBy("owner_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("count")).otherwise(1).alias("least"))
    frequent = stored(pairs.join(broadcast_if_small(least, MAX_OWNERS), "owner_id").filter(
        F.col("count") >= F.col("least")).select("owner_id", "phrase"), "frequent")
    if frequent.limit(MAX_PAIRS + 1).count() <= MAX_PAIRS:
        few = F.broadcast(frequent)
        rest = F.greatest(F.size("p") - 1, F.lit(0))
        runs = words.select("owner_id", ngrams(w, 2).alias("p")).select("owner_id", F.explode(F.arrays_zip(
            F.slice("p", F.lit(1), rest).alias("a"), F.slice("p", F.lit(2), rest).alias("b"))).alias("r")).select("owner_id", "r.a", "r.b")
        for side in ("a", "b"):
            runs = runs.join(few.withColumnRenamed("phrase", side), ["owner_id", side], "left_semi")
        triples = runs.select("owner_id", F.concat_ws(" ", "a", F.substring_index("b", " ", -1)).alias("phrase"))
    else:
        triples = words.select("owner_id", F.explode(ngrams(w, 3)).alias("phrase"))
    best = top_k(best.unionByName(counted(triples).filter(content)), ["owner_id"], order, k)
    n = corpus.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"))
    return best.join(n, "owner_id").withColumn("frequency", F.col("count") / F.col("n")).drop("n")


def signature_words(corpus: DataFrame, k: int = 50) -> DataFrame:
    """Most frequent content words, per word written."""
    words = corpus.select("owner_id", F.explode(tokens("body")).alias("word"))
    best = top_counts(words.filter(~F.col("word").isin(*STYLE_STOP_WORDS)), ["owner_id"], "word", k)
    n = corpus.groupBy("owner_id").agg(F.sum("words").alias("n"))
    return best.join(n, "owner_id").withColumn("frequency", F.col("count") / F.col("n")).drop("n")


def edge_phrases(corpus: DataFrame, k: int = 15, length: int = 5) -> DataFrame:
    """Most frequent openings and closings of texts."""
    w = F.col("w")
    edges = F.array(
        F.struct(F.lit("start").alias("edge"), F.slice(w, 1, length).alias("p")),
        F.struct(F.lit("end").alias("edge"),
                 F.slice(w, F.greatest(F.size(w) - (length - 1), F.lit(1)), F.lit(length))
                 .alias("p")))
    rows = (
        corpus.select("owner_id", tokens("body").alias("w"))
        .select("owner_id", F.explode(edges).alias("e"))
        .select("owner_id", "e.edge", F.array_join("e.p", " ").alias("phrase"))
        .filter(F.col("phrase") != "")
    )
    return top_counts(rows, ["owner_id", "edge"], "phrase", k)


def example_texts(corpus: DataFrame, representative: int = 10, engaging: int = 5,
                  min_length: int = 80) -> DataFrame:
    """Texts of nearly median length, and those with the highest scores."""
    sized = corpus.select("owner_id", "seq", "words", F.coalesce("score", F.lit(0.0)).alias("score"),
                          one_line("body").alias("example")).withColumn("_text", F.md5("example"))
    slim = sized.filter(F.length("example") >= min_length).drop("example")
    median = corpus.groupBy("owner_id").agg(F.percentile("words", F.lit(0.5)).alias("median"))
    # Ranked on numbers; the texts of the few picked rows are fetched afterwards.
    rows = slim.join(median, "owner_id").withColumn(
        "distance", F.abs(F.col("words") - F.col("median")))
    typical = top_k(rows, ["owner_id"], [F.asc("distance"), F.asc("seq"), F.asc("_text")], representative)
    liked = top_k(rows, ["owner_id"], [F.desc("score"), F.asc("seq"), F.asc("_text")], engaging)
    picked = typical.withColumn("kind", F.lit("representative")).unionByName(
        liked.withColumn("kind", F.lit("engaging"))).select("owner_id", "seq", "_text", "kind", "rank")
    key = ["owner_id", "seq", "_text"]
    return sized.select(*key, "example").dropDuplicates(key).join(picked, key).select(
        "owner_id", "kind", "rank", "seq", "example")


def rows_of_year(rows: DataFrame, anchors: DataFrame, years_ago: int) -> DataFrame:
    """Rows of the calendar year ``years_ago`` before each owner's newest dated row."""
    year = anchors.groupBy("owner_id").agg(
        (F.year(F.max("created_at")) - years_ago).cast("long").alias("target_year"))
    year = broadcast_if_small(year, MAX_OWNERS)
    return rows.join(year, "owner_id").filter(F.year("created_at") == F.col("target_year"))


def voice_of_year(comments: DataFrame, posts: DataFrame, years_ago: int) -> DataFrame:
    """Style, volume and communities of one year."""
    anchors = comments.select("owner_id", "created_at").unionByName(
        posts.select("owner_id", "created_at"))
    c = rows_of_year(comments, anchors, years_ago)
    p = rows_of_year(posts, anchors, years_ago)
    slim = [x.select("owner_id", "target_year", "subreddit", F.lit(k).alias("kind"))
            for x, k in ((c, "comment"), (p, "post"))]
    both = slim[0].unionByName(slim[1])
    volume = both.groupBy("owner_id", "target_year").agg(
        F.count_if(F.col("kind") == "comment").alias("comments"),
        F.count_if(F.col("kind") == "post").alias("posts"))
    communities = top_counts(
        both.filter(F.col("subreddit").isNotNull()), ["owner_id"], "subreddit", 4)
    listed = communities.groupBy("owner_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "subreddit"))),
        lambda s: F.concat(F.lit("r/"), s["subreddit"])), ", ").alias("communities"))
    numbers = style_numbers(style_corpus(c)).select(
        "owner_id", "casual", "formal", "humorous", "serious", "avg_length", "vocabulary")
    return volume.join(listed, "owner_id", "left").join(numbers, "owner_id", "left")


def style_envelope(messages: DataFrame) -> DataFrame:
    """Length target and mark rates of an owner's own messages, rounded for display."""
    clean = messages.select("owner_id", strip("text").alias("text")).filter(F.col("text") != "")
    counted = clean.withColumn("words", word_count("text"))
    n = F.count(F.lit(1))

    def rate(test: Column) -> Column:
        return F.round(F.count_if(test) / n, 2)

    avg, median = F.avg("words"), F.percentile("words", F.lit(0.5))
    base = F.when(median != 0, median).when(avg != 0, avg).otherwise(12.0)
    numbers = counted.groupBy("owner_id").agg(
        F.round(avg, 1).alias("avg_words"), F.round(median, 1).alias("median_words"),
        # Halves go up, as in the display rounding of the original numbers.
        F.greatest(F.lit(4), F.floor(base + 0.5)).cast("long").alias("target_words"),
        F.greatest(F.lit(6), F.floor(base * 1.35 + 0.5)).cast("long").alias("max_words"),
        rate(F.col("text").endswith("?")).alias("question_rate"),
        rate(F.contains("text", F.lit("!"))).alias("exclaim_rate"),
        rate(F.contains("text", F.lit("..."))).alias("ellipses_rate"),
        rate(F.col("text").rlike("^[a-z]")).alias("lowercase_start_rate"),
        rate(F.col("text").rlike(EMOJI)).alias("emoji_rate"),
        F.round(F.sum(count_matches("text", r"[.!?,]")) / n, 2).alias("punctuation_per_message"))
    return numbers
