"""Writing style."""

from pyspark.sql import functions as F

from keepsake.functions.lexicons import CONJUNCTIONS, CONTRACTIONS, HUMOUR, SERIOUS, SLANG
from keepsake.operators import voice
from keepsake.plans.q_corpus import STOP, TRIM, ranked
from keepsake.plans.registry import query


def alternatives(words):
    return "|".join(words).replace("'", "''")


CORPUS = f"""(SELECT *, len(w) AS words FROM (
    SELECT owner_id, seq, subreddit, score, created_at, trim(body, {TRIM}) AS body,
           regexp_extract_all(lower(body), '[a-z0-9'']+') AS w FROM v_comment)
    WHERE len(w) >= 5 AND lower(body) NOT IN ('[deleted]', '[removed]'))"""


def found(pattern):
    return f"len(regexp_extract_all(body, '{pattern}'))"


COUNTS = f"""(SELECT *,
    {found(rf"(?i)\b(?:{alternatives(CONTRACTIONS)})\b")} + {found(rf"(?i)\b(?:{alternatives(SLANG)})\b")} AS casual_hits,
    regexp_matches(body, '^[A-Z]')::INT AS capital_start,
    {found(rf"(?i)\b(?:{alternatives(HUMOUR)})\b")} AS humour_hits,
    {found(rf"(?i)\b(?:{alternatives(SERIOUS)})\b")} AS serious_hits,
    {found(r"\*[^*]+\*|\b[A-Z]{3,}\b")} AS passion_hits,
    {found("!")} AS exclamations, {found(r"\?")} AS questions, {found(r"\.\.\.")} AS ellipses,
    {found("—|--")} AS em_dashes, {found(r"\([^)]*\)")} AS parentheticals, {found('["“”]')} AS quotes,
    list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
        lambda s: trim(s, {TRIM})), lambda s: s <> '') AS pieces,
    greatest(1, len(list_filter(regexp_split_to_array(body, '\\n\\n+'), lambda p: p <> ''))) AS paragraphs,
    len(list_filter(w, lambda x: length(x) >= 9)) AS long_words
    FROM {CORPUS})"""

NUMBERS = f"""(SELECT owner_id, count(*) AS texts, sum(words) AS total_words,
    avg(words) AS avg_length, median(words) AS median_length,
    avg((words < 20)::INT) AS short_share, avg((words > 100)::INT) AS long_share,
    least(1, sum(casual_hits) / (3 * count(*))) AS casual, avg(capital_start) AS formal,
    least(1, sum(humour_hits) / count(*)) AS humorous, least(1, sum(serious_hits) / count(*)) AS serious,
    least(1, sum(passion_hits) / count(*)) AS passionate,
    sum(exclamations) / count(*) AS exclamations_per_text, sum(questions) / count(*) AS questions_per_text,
    sum(ellipses) / count(*) AS ellipses_per_text, sum(em_dashes) / count(*) AS em_dashes_per_text,
    100 * sum(parentheticals) / sum(words) AS parentheticals_per_100_words,
    100 * sum(quotes) / sum(words) AS quotes_per_100_words,
    sum(list_sum(list_transform(pieces, lambda s: len(regexp_extract_all(lower(s), '[a-z0-9'']+')))))
      / sum(len(list_filter(pieces, lambda s: regexp_matches(lower(s), '[a-z0-9'']')))) AS words_per_sentence,
    sum(len(list_filter(pieces, lambda s: regexp_matches(s, '(?i),|;|\\b(?:{"|".join(CONJUNCTIONS)})\\b'))))
      / sum(len(pieces)) AS complex_share,
    sum(paragraphs) / count(*) AS paragraphs_per_text,
    sum(long_words) / sum(words) AS long_word_ratio
    FROM {COUNTS} GROUP BY owner_id)"""

GROUPS = {
    "agg_14_length": ["avg_length", "median_length", "short_share", "long_share"],
    "agg_17_tone": ["casual", "formal", "humorous", "serious", "passionate"],
    "agg_18_punctuation": [
        "exclamations_per_text", "questions_per_text", "ellipses_per_text", "em_dashes_per_text",
        "parentheticals_per_100_words", "quotes_per_100_words"],
    "agg_19_sentences": ["words_per_sentence", "complex_share", "paragraphs_per_text"],
    "agg_21_vocabulary": ["long_word_ratio"],
}
LEVEL = """CASE WHEN long_word_ratio > 0.18 THEN 'technical' WHEN long_word_ratio > 0.12 THEN 'advanced'
    WHEN long_word_ratio > 0.08 THEN 'moderate' ELSE 'simple' END AS vocabulary"""


def register(name, columns):
    extra = ", " + LEVEL if name == "agg_21_vocabulary" else ""

    @query(name, f"SELECT owner_id, texts, CAST(total_words AS BIGINT) AS total_words, "
                 + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)
                 + f"{extra} FROM {NUMBERS}")
    def _(t):
        numbers = voice.style_numbers(voice.style_corpus(t.comments()))
        keep = ["vocabulary"] if extra else []
        return numbers.select("owner_id", "texts", "total_words",
                              *[F.round(c, 6).alias(c) for c in columns], *keep)


for _name, _columns in GROUPS.items():
    register(_name, _columns)

GRAMS = f"""(SELECT * FROM (
    SELECT owner_id, w[i] || ' ' || w[i + 1] AS phrase, w[i] AS a, w[i + 1] AS b, NULL AS c
    FROM {CORPUS}, generate_series(1, len(w) - 1) g(i)
    UNION ALL
    SELECT owner_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], w[i], w[i + 1], w[i + 2]
    FROM {CORPUS}, generate_series(1, len(w) - 2) g(i))
    WHERE a NOT IN ({STOP}) OR b NOT IN ({STOP}) OR (c IS NOT NULL AND c NOT IN ({STOP})))"""


@query("agg_15_common_phrases", f"""
    SELECT owner_id, phrase, p.count, rank, round(p.count / n, 6) AS frequency
    FROM ({ranked('phrase', GRAMS, 20)}) p
    JOIN (SELECT owner_id, count(*) AS n FROM {CORPUS} GROUP BY 1) USING (owner_id)""")
def _(t):
    return voice.common_phrases(voice.style_corpus(t.comments())).withColumn(
        "frequency", F.round("frequency", 6))


@query("agg_16_signature_words", f"""
    SELECT owner_id, word, p.count, rank, round(p.count / n, 6) AS frequency
    FROM ({ranked('word', f'''(SELECT * FROM (SELECT owner_id, unnest(w) AS word FROM {CORPUS})
                               WHERE word NOT IN ({STOP}))''', 50)}) p
    JOIN (SELECT owner_id, sum(words) AS n FROM {CORPUS} GROUP BY 1) USING (owner_id)""")
def _(t):
    return voice.signature_words(voice.style_corpus(t.comments())).withColumn(
        "frequency", F.round("frequency", 6))


@query("agg_20_edge_phrases", f"""
    SELECT owner_id, edge, phrase, count(*) AS count,
           row_number() OVER (PARTITION BY owner_id, edge ORDER BY count(*) DESC, phrase) AS rank
    FROM (SELECT owner_id, 'start' AS edge, array_to_string(w[1:5], ' ') AS phrase FROM {CORPUS}
          UNION ALL
          SELECT owner_id, 'end', array_to_string(w[greatest(len(w) - 4, 1):len(w)], ' ') FROM {CORPUS})
    GROUP BY owner_id, edge, phrase
    QUALIFY row_number() OVER (PARTITION BY owner_id, edge ORDER BY count(*) DESC, phrase) <= 15""")
def _(t):
    return voice.edge_phrases(voice.style_corpus(t.comments()))


@query("win_12_example_texts", rf"""WITH rows AS (
        SELECT owner_id, seq, score, trim(regexp_replace(body, '\s+', ' ', 'g')) AS example,
               abs(words - median(words) OVER (PARTITION BY owner_id)) AS distance FROM {CORPUS}),
    long AS (SELECT * FROM rows WHERE length(example) >= 80)
    SELECT owner_id, 'representative' AS kind, seq, example,
           row_number() OVER (PARTITION BY owner_id ORDER BY distance, seq) AS rank FROM long
    QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY distance, seq) <= 10
    UNION ALL
    SELECT owner_id, 'engaging', seq, example,
           row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, seq) FROM long
    QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, seq) <= 5""")
def _(t):
    return voice.example_texts(voice.style_corpus(t.comments()))


@query("agg_22_voice_of_year", f"""WITH allrows AS (
        SELECT owner_id, created_at, subreddit, 'c' AS kind FROM v_comment
        UNION ALL SELECT owner_id, created_at, subreddit, 'p' FROM v_post),
    target AS (SELECT owner_id, max(year(created_at)) AS target_year FROM allrows GROUP BY 1),
    inyear AS (SELECT b.*, target_year FROM allrows b JOIN target USING (owner_id)
               WHERE year(created_at) = target_year),
    subs AS (SELECT owner_id, string_agg('r/' || subreddit, ', ' ORDER BY rank) AS communities
             FROM ({ranked('subreddit', 'inyear', 4)}) GROUP BY 1),
    numbers AS (SELECT * FROM {NUMBERS})
    SELECT owner_id, CAST(target_year AS BIGINT) AS target_year,
           count(*) FILTER (kind = 'c') AS comments, count(*) FILTER (kind = 'p') AS posts,
           communities, round(CAST(casual AS DOUBLE), 6) AS casual, round(CAST(formal AS DOUBLE), 6) AS formal,
           round(CAST(humorous AS DOUBLE), 6) AS humorous, round(CAST(serious AS DOUBLE), 6) AS serious,
           round(avg_length, 6) AS avg_length, {LEVEL}
    FROM inyear JOIN subs USING (owner_id) JOIN numbers USING (owner_id)
    GROUP BY ALL""")
def _(t):
    out = voice.voice_of_year(t.comments(), t.posts(), years_ago=0)
    for c in ("casual", "formal", "humorous", "serious", "avg_length"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("agg_24_style_envelope", rf"""WITH msgs AS (
        SELECT owner_id, trim(text, {TRIM}) AS text FROM v_msg WHERE is_user_message),
    c AS (SELECT *, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS words FROM msgs WHERE text <> ''),
    g AS (SELECT owner_id, avg(words) AS a, median(words) AS m, count(*) AS n,
          count(*) FILTER (text LIKE '%?') AS q, count(*) FILTER (contains(text, '!')) AS x,
          count(*) FILTER (contains(text, '...')) AS e, count(*) FILTER (regexp_matches(text, '^[a-z]')) AS l,
          count(*) FILTER (regexp_matches(text, '[\x{{2600}}-\x{{27BF}}\x{{1F000}}-\x{{1FAFF}}]')) AS j,
          sum(len(regexp_extract_all(text, '[.!?,]'))) AS p FROM c GROUP BY 1)
    SELECT owner_id, round(a, 1) AS avg_words, round(m, 1) AS median_words,
        CAST(greatest(4, floor(CASE WHEN m <> 0 THEN m WHEN a <> 0 THEN a ELSE 12 END + 0.5)) AS BIGINT) AS target_words,
        CAST(greatest(6, floor(1.35 * CASE WHEN m <> 0 THEN m WHEN a <> 0 THEN a ELSE 12 END + 0.5)) AS BIGINT) AS max_words,
        round(q / n, 2) AS question_rate, round(x / n, 2) AS exclaim_rate, round(e / n, 2) AS ellipses_rate,
        round(l / n, 2) AS lowercase_start_rate, round(j / n, 2) AS emoji_rate,
        round(p / n, 2) AS punctuation_per_message FROM g""")
def _(t):
    return voice.style_envelope(t.messages().filter("is_user_message"))
