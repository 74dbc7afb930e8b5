"""Questions: intent, extraction, and counted answers."""

import re

from pyspark.sql import functions as F

from keepsake.functions import questions as ask
from keepsake.functions.text import phrase_variants, tokens
from keepsake.functions.lexicons import PHRASE_ABBREVIATIONS
from keepsake.functions.lexicons import COMPARE_NEGATIVE, COMPARE_POSITIVE, TREND_NEGATIVE, TREND_POSITIVE
from keepsake.operators import questions, retrieval
from keepsake.plans.q_retrieval import FORUM, snip
from keepsake.plans.registry import query

NOW = "2024-06-01 12:30:00"
# A question per text, made of its first words; its number picks the wording.
FORMS = [
    ('how many times did I say "', "{a} {b}", '"?'), ("what was I like ", "{n}", " years ago"),
    ("", "{a}", " vs {b}?"), ("how has my view shifted on ", "{a} {b}", "?"),
    ("how did I ", "change", ""), ("Does user_", "{n}", " know about my {a}?"),
    ("What did I tell user_", "{n}", " about {a} {b}?"),
    ("summarize my conversation with ", "user_{n}", ""), ("back in 20", "1{n}", " with {a} {b} ?"),
    ("what did we talk about ", "{a}", "?"), ("difference between ", "{a}", " and {b}?"),
    ('is "', "{a} {b}", '" one of my most used phrases'), ("what was I like in ", "covid", " times"),
    ("Did I tell User_", "{n}", " about {a}"), ("have I mentioned ", "{a} {b}", " to user_{n}?"),
    ("do I still think ", "{a}", " or {b}"), ("list texts with ", '"user_{n}"', ""),
    ("what happened ", "{n}", " weeks ago, about {a} with {b}"),
]


def question_sql(table, number):
    def cell(part):
        out = "'" + part.replace("'", "''") + "'"
        for k, v in (("{a}", "a"), ("{b}", "b"), ("{n}", "(question_id % 9 + 1)")):
            out = out.replace(k, f"' || {v} || '")
        return out
    cases = " ".join(f"WHEN {i} THEN {cell(''.join(f))}" for i, f in enumerate(FORMS))
    return f"""asked AS (SELECT question_id, owner_id, CASE question_id % {len(FORMS)} {cases} END AS question
        FROM (SELECT *, w[1 + 7 * question_id % len(w)] AS a, w[1 + (7 * question_id + 3) % len(w)] AS b
              FROM (SELECT {number} AS question_id, 'o' || ({number} % 3) AS owner_id,
                           regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM {table}) WHERE len(w) >= 2))"""


def asked(t, table, number):
    n = F.col(number)

    def text(form):
        pieces = []
        for p in re.split(r"(\{[abn]\})", "".join(form)):
            pieces.append({"{a}": F.col("a"), "{b}": F.col("b"), "{n}": (n % 9 + 1).cast("string")}.get(p, F.lit(p)))
        return F.concat(*pieces)

    out = None
    for i, f in enumerate(FORMS):
        test = n % len(FORMS) == i
        out = F.when(test, text(f)) if out is None else out.when(test, text(f))
    # Two words at places that move over the texts.
    rows = t.raw(table).select(number, tokens("text").alias("w")).filter(F.size("w") >= 2).select(
        number, *[F.get("w", ((n * 7 + k) % F.size("w")).cast("int")).alias(c) for c, k in (("a", 0), ("b", 3))])
    return rows.select(n.alias("question_id"), t.owner(number), out.alias("question"))


DOCS = question_sql("documents", "doc_id")
BENCH = question_sql("benchmark", "item_id")


def any_of(patterns):
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


INTENT = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(trim(question)), '{any_of(p)}') THEN '{k}'" for k, p in (
        ("phrase_frequency", ask.PHRASE_PATTERNS), ("time_period", ask.TIME_PATTERNS),
        ("comparison", ask.COMPARE_PATTERNS), ("evolution", ask.CHANGE_PATTERNS))) + " ELSE 'general' END"


@query("fn_29_intent", f"""WITH {DOCS}, i AS (SELECT *, {INTENT} AS intent FROM asked)
    SELECT question_id, question, intent, CASE intent WHEN 'phrase_frequency' THEN 0.9::DOUBLE WHEN 'time_period'
        THEN 0.85::DOUBLE WHEN 'general' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM i""")
def _(t):
    return asked(t, "documents", "doc_id").withColumn("intent", ask.intent("question")).select(
        "question_id", "question", "intent", ask.intent_confidence("intent").alias("confidence"))


def grp(p, n=1, q="question"):
    p = p.replace("'", "''").replace(r"\z", "$")
    return f"nullif(trim(regexp_extract({q}, '{p}', {n})), '')"


PHRASE = "coalesce(" + ", ".join(grp(p) for p in (
    r"""["']([^"']+)["']""", r"""(?i)(?:say|use|mention)\s+["']?([^"'?]+)["']?""",
    r"""(?i)word\s+["']?([^"'?]+)["']?""", r"""(?i)phrase\s+["']?([^"'?]+)["']?""")) + ", '')"
REL = r"(?i)(\d+)\s+(year|month|week)s?\s+ago"
FRAME = rf"""f AS (SELECT *, try_cast(regexp_extract(question, '{REL}', 1) AS INT) AS amount,
        lower(regexp_extract(question, '{REL}', 2)) AS unit,
        try_cast(regexp_extract(question, '\b(20\d{{2}})\b', 1) AS INT) AS y,
        regexp_matches(question, '(?i)pandemic|covid') AS covid FROM asked),
    frames AS (SELECT *, CASE WHEN unit <> '' THEN amount || ' ' || unit || 's ago' WHEN y IS NOT NULL THEN y::VARCHAR
            WHEN covid THEN 'pandemic' ELSE 'recent' END AS value,
        CASE WHEN unit = 'week' THEN TIMESTAMP '{NOW}' - to_days(7 * amount)
            WHEN unit = 'month' THEN TIMESTAMP '{NOW}' - to_months(amount)
            WHEN unit = 'year' THEN TIMESTAMP '{NOW}' - to_years(amount)
            WHEN y IS NOT NULL THEN make_timestamp(y, 1, 1, 0, 0, 0)
            WHEN covid THEN TIMESTAMP '2020-01-01' END AS a,
        CASE WHEN unit <> '' THEN TIMESTAMP '{NOW}' WHEN y IS NOT NULL THEN make_timestamp(y, 12, 31, 23, 59, 59)
            WHEN covid THEN TIMESTAMP '2021-12-31 23:59:59' END AS b FROM f)"""
VS, BETWEEN = r"(?i)(.+?)\s+(?:vs|versus|or)\s+(.+?)(?:\?|$)", r"(?i)between\s+(.+?)\s+and\s+(.+?)(?:\?|$)"
TOPICS = " ".join(["CASE"] + [
    f"WHEN regexp_matches(question, '{p}') THEN [trim(regexp_extract(question, '{p}', 1)), trim(regexp_extract(question, '{p}', 2))]"
    for p in (VS, BETWEEN)]) + " ELSE [] END"
CHANGE = "coalesce(" + grp(rf"(?i)(?:on|about|regarding)\s+(.+?)(?:\?|$)") + ", '')"


@query("fn_30_extracted_parts", f"""WITH {DOCS}, {FRAME}
    SELECT question_id, {PHRASE} AS phrase, value, strftime(a, '%Y-%m-%d %H:%M:%S') AS starts,
        strftime(b, '%Y-%m-%d %H:%M:%S') AS ends, array_to_string({TOPICS}, '|') AS topics,
        {CHANGE} AS change_topic FROM frames""")
def _(t):
    r = questions.routed(asked(t, "documents", "doc_id"), F.lit(NOW).cast("timestamp"))
    return r.select(
        "question_id", "phrase", "timeframe.value",
        F.date_format("timeframe.start", "yyyy-MM-dd HH:mm:ss").alias("starts"),
        F.date_format("timeframe.end", "yyyy-MM-dd HH:mm:ss").alias("ends"),
        F.array_join("topics", "|").alias("topics"), "change_topic")


LOW = "lower(question)"
DIS = [(p.replace(r"\z", "$"), a, b) for p, a, b in ask.DISCLOSURE]


def dis(pick):
    return "coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches({LOW}, '{p}') THEN trim(regexp_extract({LOW}, '{p}', {(a, b)[pick]})) END"
        for p, a, b in DIS) + ")"


@query("fn_31_people_and_topics", f"""WITH {DOCS}
    SELECT question_id, {dis(0)} AS name, {dis(1)} AS topic,
        coalesce({grp("what did i (?:tell|say to|talk to) .+? about (.+?)(?:[?]|$)", 1, LOW)},
            {grp("what did we talk about (.+?)(?:[?]|$)", 1, LOW)}, {grp("about (.+?) with ", 1, LOW)}) AS asked_topic,
        (regexp_matches({LOW}, '{ask.SUMMARY_VERBS.replace("'", "''")}') AND regexp_matches({LOW}, '{ask.SUMMARY_NOUNS}'))
            OR regexp_matches({LOW}, '{ask.SUMMARY_ASKS}') AS summary FROM asked""")
def _(t):
    d = ask.disclosure_parts("question")
    return asked(t, "documents", "doc_id").select(
        "question_id", d["name"].alias("name"), d["topic"].alias("topic"),
        ask.topic_asked("question").alias("asked_topic"), ask.asks_summary("question").alias("summary"))


TAIL = r"\s+(.+?)\s*\??\s*$"


@query("fn_32_lookup_names", rf"""WITH {DOCS}
    SELECT question_id, coalesce({grp(r"(?i)\bwith" + TAIL)}, {grp('"([^"]{2,80})"')},
            {grp(r"(?i)\b(?:with|containing|for)" + TAIL)}) AS name,
        {grp(r"(?i)\babout" + TAIL)} AS topic, {grp('"([^"]{2,120})"')} AS quoted,
        try_cast(regexp_extract({LOW}, '\b(\d{{1,2}})\s+years?\s+ago\b', 1) AS BIGINT) AS years_ago,
        regexp_matches({LOW}, '{ask.LEXICAL_PATTERN}') AS lexical FROM asked""")
def _(t):
    return asked(t, "documents", "doc_id").select(
        "question_id", ask.lookup_name("question").alias("name"),
        ask.about_topic("question").alias("topic"), ask.quoted_phrase("question").alias("quoted"),
        ask.years_ago("question").cast("long").alias("years_ago"),
        ask.asks_lexical("question").alias("lexical"))


PAIRS = ", ".join("('" + k.replace("'", "''") + f"', '{v}')" for k, v in PHRASE_ABBREVIATIONS.items())
VARIANTS = rf"""list_sort(list_distinct([trim(lower(p)), regexp_replace(trim(lower(p)), '[^A-Za-z0-9_\s'']', '', 'g'),
    regexp_replace(trim(lower(p)), '\s+', ' ', 'g')]
    || coalesce((SELECT list(s) FROM (VALUES {PAIRS}) v(l, s) WHERE l = trim(lower(p))), [])
    || coalesce((SELECT list(l) FROM (VALUES {PAIRS}) v(l, s) WHERE s = trim(lower(p))), [])))"""
STOCK = ["to be honest", "tbh", "not  gonna lie", "ngl", "BTW", "for what it's worth"]


@query("fn_13_phrase_variants", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0
        THEN ([{", ".join("'" + s.replace("'", "''") + "'" for s in STOCK)}])[doc_id % 6 + 1]
        ELSE split_part(text, ' ', 1) || '  ' || split_part(text, ' ', 2) END AS p FROM documents)
    SELECT doc_id, array_to_string({VARIANTS}, '|') AS variants FROM d""")
def _(t):
    n = F.col("doc_id")
    stock = F.element_at(F.array(*[F.lit(s) for s in STOCK]), (n % 6 + 1).cast("int"))
    p = F.when(n % 3 == 0, stock).otherwise(F.concat(
        F.split_part("text", F.lit(" "), F.lit(1)), F.lit("  "),
        F.split_part("text", F.lit(" "), F.lit(2))))
    return t.raw("documents").select("doc_id", p.alias("p")).select(
        "doc_id", F.array_join(F.array_sort(phrase_variants("p")), "|").alias("variants"))


@query("jn_11_named_contacts", f"""WITH {DOCS}, contact AS (
        SELECT owner_id, contact, min(seq) AS seq FROM v_evt GROUP BY ALL),
    slug AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(contact), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS s FROM contact),
    hit AS (SELECT a.owner_id, question_id, contact, seq,
        CASE WHEN contains({LOW}, lower(contact)) OR contains({LOW}, s) THEN 0
             WHEN len([p for p in regexp_split_to_array(contact, '[_\\s]+') if length(p) >= 3 AND contains({LOW}, lower(p))]) > 0
             THEN 1 END AS priority FROM asked a JOIN slug c ON c.owner_id = a.owner_id)
    SELECT owner_id, question_id, contact, CAST(priority AS BIGINT) AS priority FROM hit WHERE priority IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY owner_id, question_id ORDER BY priority, seq) = 1""")
def _(t):
    contacts = t.dense().groupBy("owner_id", "contact").agg(F.min("seq").alias("seq"))
    return questions.named_contacts(asked(t, "documents", "doc_id"), contacts).withColumn(
        "priority", F.col("priority").cast("long"))


def bench(t):
    return asked(t, "benchmark", "item_id")


def forum(t):
    return retrieval.forum_rows(t.comments(), t.posts())


WORDS2 = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
# Two neighbouring words of each benchmark text, at a place that moves over the texts, are a phrase that its owner is asked about.
PHRASED = f"""asked AS (SELECT item_id AS question_id, 'o' || (item_id % 3) AS owner_id, w[i] || ' ' || w[i + 1] AS phrase,
        w[i] AS topic, [w[i], w[i + 1]] AS topics
        FROM (SELECT *, 1 + 7 * item_id % (len(w) - 1) AS i FROM (SELECT item_id, {WORDS2} AS w FROM benchmark) WHERE len(w) >= 2))"""


def phrased(t):
    rows = t.raw("benchmark").withColumn("w", tokens("text")).filter(F.size("w") >= 2)
    i = (F.col("item_id") * 7 % (F.size("w") - 1)).cast("int")
    a, b = F.get("w", i), F.get("w", i + 1)
    return rows.select(
        F.col("item_id").alias("question_id"), t.owner("item_id"),
        F.concat_ws(" ", a, b).alias("phrase"), a.alias("topic"), F.array(a, b).alias("topics"))


def dates(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


@query("agg_27_phrase_frequency", f"""WITH {PHRASED}, {FORUM},
    f2 AS (SELECT * FROM forum WHERE place < 2),
    m AS (SELECT a.owner_id, question_id, created_at FROM asked a JOIN f2 f
          ON f.owner_id = a.owner_id AND contains(lower(text), phrase))
    SELECT a.owner_id, a.question_id, phrase, count(m.question_id) AS matches, total_items,
        strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at,
        round(count(m.question_id) / total_items * 100, 1) AS share_percent
    FROM asked a JOIN (SELECT owner_id, count(*) AS total_items FROM f2 GROUP BY 1) USING (owner_id)
    LEFT JOIN m ON m.owner_id = a.owner_id AND m.question_id = a.question_id
    GROUP BY a.owner_id, a.question_id, phrase, total_items""")
def _(t):
    return dates(questions.phrase_frequency(forum(t), phrased(t)), "first_at", "last_at")


LEX = rf"""p AS (SELECT *, '(?i)\b' || replace(phrase, ' ', '\W+') || '\b' AS pattern FROM asked),
    h AS (SELECT p.owner_id, question_id, kind, id, place, seq, score, text,
            len(regexp_extract_all(text, pattern)) AS occurrences,
            length(regexp_extract(text, '(?is)^(.*?)' || pattern[5:], 1)) AS pos
          FROM p JOIN forum f ON f.owner_id = p.owner_id AND place < 2
          WHERE regexp_matches(text, pattern))"""


@query("agg_28_lexical_counts", f"""WITH {PHRASED}, {FORUM}, {LEX}
    SELECT owner_id, question_id, CAST(sum(occurrences) AS BIGINT) AS total_matches, count(*) AS matched_items
    FROM h GROUP BY ALL""")
def _(t):
    return questions.lexical_counts(questions.lexical_hits(forum(t), phrased(t)))


@query("top_04_lexical_examples", f"""WITH {PHRASED}, {FORUM}, {LEX}
    SELECT owner_id, question_id, kind, id, {snip('pos', 90, 220)} AS snippet,
        row_number() OVER (PARTITION BY owner_id, question_id ORDER BY coalesce(score, 0) DESC, place, seq) AS rank FROM h
    QUALIFY row_number() OVER (PARTITION BY owner_id, question_id ORDER BY coalesce(score, 0) DESC, place, seq) <= 6""")
def _(t):
    return questions.lexical_examples(questions.lexical_hits(forum(t), phrased(t))).select(
        "owner_id", "question_id", "kind", "id", "snippet", "rank")


def sentiment(low, positive, negative):
    return (" + ".join(f"contains({low}, '{p}')::INT" for p in positive) + " - "
            + " - ".join(f"contains({low}, '{n}')::INT" for n in negative))


@query("agg_30_comparison", f"""WITH {PHRASED}, sides AS (
        SELECT owner_id, question_id, 0 AS side, topics[1] AS topic FROM asked UNION ALL
        SELECT owner_id, question_id, 1, topics[2] FROM asked),
    h AS (SELECT s.owner_id, question_id, side, lower(body) AS low, seq FROM sides s JOIN v_comment c
          ON c.owner_id = s.owner_id AND length(topic) >= 3 AND contains(lower(body), topic)
          QUALIFY row_number() OVER (PARTITION BY s.owner_id, question_id, side ORDER BY seq) <= 8),
    g AS (SELECT owner_id, question_id, side, count(*) AS items,
                 sum({sentiment('low', COMPARE_POSITIVE, COMPARE_NEGATIVE)}) AS score FROM h GROUP BY ALL)
    SELECT owner_id, question_id, CAST(side AS BIGINT) AS side, topic, coalesce(items, 0) AS items, CASE WHEN score > 0
        THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS sentiment
    FROM sides LEFT JOIN g USING (owner_id, question_id, side)""")
def _(t):
    return questions.comparison(t.comments(), phrased(t)).withColumn("side", F.col("side").cast("long"))


TREND = (f"regexp_matches(lower(body), '\\b(?:{'|'.join(TREND_POSITIVE)})\\b')::INT - "
         f"regexp_matches(lower(body), '\\b(?:{'|'.join(TREND_NEGATIVE)})\\b')::INT")
EVO = f"""h AS (SELECT a.owner_id, question_id, id, seq,
        year(created_at) || '-Q' || quarter(created_at) AS quarter, {TREND} AS s
    FROM asked a JOIN v_comment c ON c.owner_id = a.owner_id AND length(topic) >= 3 AND contains(lower(body), topic))"""


@query("agg_29_evolution", f"""WITH {PHRASED}, {EVO}
    SELECT owner_id, question_id, quarter, count(*) AS items, round(avg(s), 6) AS sentiment,
        row_number() OVER (PARTITION BY owner_id, question_id ORDER BY quarter DESC) AS rank FROM h
    GROUP BY owner_id, question_id, quarter
    QUALIFY row_number() OVER (PARTITION BY owner_id, question_id ORDER BY quarter DESC) <= 8""")
def _(t):
    return questions.evolution(questions.evolution_rows(t.comments(), phrased(t))).withColumn(
        "sentiment", F.round("sentiment", 6))


@query("win_13_evolution_examples", f"""WITH {PHRASED}, {EVO}
    SELECT owner_id, question_id, quarter, id,
        row_number() OVER (PARTITION BY owner_id, question_id, quarter ORDER BY seq) AS rank FROM h
    QUALIFY dense_rank() OVER (PARTITION BY owner_id, question_id ORDER BY quarter DESC) <= 8
        AND row_number() OVER (PARTITION BY owner_id, question_id, quarter ORDER BY seq) <= 2""")
def _(t):
    return questions.evolution_examples(questions.evolution_rows(t.comments(), phrased(t))).select(
        "owner_id", "question_id", "quarter", "id", "rank")


@query("agg_31_time_period", f"""WITH {BENCH}, {FRAME}, {FORUM},
    h AS (SELECT q.owner_id, question_id, coalesce(subreddit, 'unknown') AS c FROM frames q JOIN forum f
          ON f.owner_id = q.owner_id AND place < 2 AND (a IS NULL OR b IS NULL OR created_at BETWEEN a AND b)),
    n AS (SELECT owner_id, question_id, count(*) AS items FROM h GROUP BY ALL),
    r AS (SELECT owner_id, question_id, c, row_number() OVER (
            PARTITION BY owner_id, question_id ORDER BY count(*) DESC, c) AS rank FROM h GROUP BY owner_id, question_id, c)
    SELECT owner_id, question_id, items, string_agg('r/' || c, ', ' ORDER BY rank) AS communities
    FROM n JOIN r USING (owner_id, question_id) WHERE rank <= 5 GROUP BY ALL""")
def _(t):
    q = questions.routed(bench(t), F.lit(NOW).cast("timestamp"))
    return questions.time_period_summary(forum(t), q)


BOUND = """bound AS (SELECT owner_id, max(created_at) - INTERVAL 1 DAY AS lo FROM (
        SELECT owner_id, created_at FROM v_comment UNION ALL SELECT owner_id, created_at FROM v_post
        UNION ALL SELECT owner_id, created_at FROM v_saved UNION ALL SELECT owner_id, created_at FROM v_upvoted)
    GROUP BY 1)"""


@query("flt_03_recent_window", f"""WITH {BOUND}
    SELECT kind, count(*) AS rows FROM (
        SELECT 'comment' AS kind FROM v_comment JOIN bound USING (owner_id) WHERE created_at >= lo
        UNION ALL SELECT 'chat' FROM v_chat JOIN bound USING (owner_id)) GROUP BY 1""")
def _(t):
    bounds = questions.window_bounds((t.comments(), t.posts(), t.saved(), t.upvoted()), 0)
    rows = t.comments().select("owner_id", "created_at", F.lit("comment").alias("kind")).unionByName(
        t.chats().select("owner_id", "created_at", F.lit("chat").alias("kind")))
    return questions.in_recent_window(rows, bounds).groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"))


@query("flt_02_window_undated_pass", """
    SELECT owner_id, source, count(*) AS rows FROM v_timeline
    WHERE created_at IS NULL OR created_at BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-02 00:00:00'
    GROUP BY ALL""")
def _(t):
    from keepsake.functions.times import in_window
    a, b = (F.lit(x).cast("timestamp") for x in ("2024-01-01 06:00:00", "2024-01-02 00:00:00"))
    return t.timeline().filter(in_window("created_at", a, b)).groupBy("owner_id", "source").agg(
        F.count(F.lit(1)).alias("rows"))


@query("flt_04_timeframe_undated_fail", """
    SELECT owner_id, source, count(*) AS rows FROM v_timeline
    WHERE created_at BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-02 00:00:00' GROUP BY ALL""")
def _(t):
    from keepsake.functions.times import in_timeframe
    a, b = (F.lit(x).cast("timestamp") for x in ("2024-01-01 06:00:00", "2024-01-02 00:00:00"))
    return t.timeline().filter(in_timeframe("created_at", a, b)).groupBy("owner_id", "source").agg(
        F.count(F.lit(1)).alias("rows"))


CITED = f"""cited AS (SELECT a.owner_id, question_id, f.score, f.subreddit, f.created_at FROM asked a
    JOIN forum f ON f.owner_id = a.owner_id AND contains(lower(text), phrase))"""


def cited(t):
    rows = retrieval.forum_rows(t.comments(), t.posts(), t.saved(), t.upvoted())
    return questions.phrase_matches(rows, phrased(t))


@query("agg_43_citation_stats", f"""WITH {PHRASED}, {FORUM}, {CITED}
    SELECT owner_id, question_id, count(*) FILTER (coalesce(score, 0) > 5) AS high,
        count(DISTINCT coalesce(subreddit, 'unknown')) AS communities FROM cited GROUP BY ALL""")
def _(t):
    return questions.citation_stats(cited(t))


@query("agg_43_citations_per_year", f"""WITH {PHRASED}, {FORUM}, {CITED}
    SELECT owner_id, question_id, CAST(coalesce(year(created_at), 0) AS BIGINT) AS year, count(*) AS citations
    FROM cited GROUP BY ALL""")
def _(t):
    return questions.citations_per_year(cited(t))


@query("fn_39_citation_numbers", r"""
    SELECT doc_id, array_to_string([x for x in flatten([string_split(g, ',') for g in
        regexp_extract_all(text || ' [' || doc_id % 7 || '] and [2,' || doc_id || '][x]', '\[(\d+(?:,\d+)*)\]', 1)])
        if CAST(x AS BIGINT) >= 1], '|') AS cited FROM documents""")
def _(t):
    n = F.col("doc_id")
    answer = F.concat("text", F.lit(" ["), (n % 7).cast("string"), F.lit("] and [2,"),
                      n.cast("string"), F.lit("][x]"))
    return t.raw("documents").select("doc_id", F.array_join(F.transform(
        ask.citations(answer), lambda x: x.cast("string")), "|").alias("cited"))
