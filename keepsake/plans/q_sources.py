"""Export documents built from the tables, parsed back, and compared with the tables.

Each query forms the raw text of an export (JSON, HTML, mbox, CSV columns) from whole tables with Spark
and runs the importer on it.
"""

from pyspark.sql import functions as F

from keepsake.plans.q_corpus import TRIM
from keepsake.plans.registry import query
from keepsake.sources import chat, files, forum, instagram, mail, social_csv, takeout
from keepsake.sources.events import cut_texts

MS = "epoch_us(created_at) // 1000"


def raw(df, content, path="'doc.json'"):
    return df.select("owner_id", F.expr(path).alias("path"), content.alias("content"))


def stored(e, most=6000):
    """The length at which the compared results were cut."""
    return cut_texts(e, most)


def show(df, *cols):
    """Dates as text."""
    for c in cols or ("created_at",):
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


AT = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"


def csv_comments(t):
    c = t.comments()
    return c.select(
        "owner_id", "seq", F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), F.col("id").cast("string"))).alias("comment_id"),
        F.concat(F.lit("r/"), "subreddit").alias("community"), F.lit(" /x ").alias("link"),
        F.col("body").alias("text"), F.floor(F.unix_micros("created_at") / 1_000_000).cast("string").alias("timestamp"),
        F.col("score").cast("string").alias("ups"), F.lit("f.csv").alias("file_name"))


@query("src_02_forum_comments", f"""
    SELECT owner_id, CASE WHEN id % 5 > 0 THEN 'c' || id ELSE 'comment-f.csv-' || seq END AS id, subreddit, '/x' AS permalink,
        CASE WHEN trim(body, {TRIM}) = '' THEN '' ELSE body END AS body, {AT}, score FROM v_comment""")
def _(t):
    return show(forum.comments(csv_comments(t))).drop("seq")


@query("src_03_forum_posts", f"""
    SELECT owner_id, 'p' || id AS id, subreddit, permalink, title, body, {AT}, score FROM v_post""")
def _(t):
    p = t.posts().select(
        "owner_id", "seq", F.concat(F.lit("p"), F.col("id").cast("string")).alias("post_id"), "subreddit",
        F.col("permalink").alias("url"), F.col("title").alias("subject"), F.col("body").alias("selftext"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("score").cast("string").alias("score"))
    return show(forum.posts(p)).drop("seq")


DIRECTIONS = ["up", "1", "down", "0", "Upvoted ", "1.0", "-1"]


def votes(t):
    d = F.element_at(F.array(*[F.lit(x) for x in DIRECTIONS]), (F.col("seq") % 7 + 1).cast("int"))
    return t.upvoted().select(
        "owner_id", "seq", F.col("id").cast("string").alias("thing_id"), F.col("subreddit").alias("subreddit_name"),
        F.col("permalink").alias("link"), d.alias("vote_direction"))


@query("src_04_upvoted", """
    SELECT owner_id, CAST(id AS VARCHAR) AS id, subreddit, permalink FROM v_upvoted WHERE seq % 7 IN (0, 1, 4, 5)
    UNION ALL SELECT owner_id, CAST(id AS VARCHAR), subreddit, permalink FROM v_saved""")
def _(t):
    legacy = t.saved().select("owner_id", "seq", F.col("id").cast("string").alias("id"), "subreddit", "permalink")
    return forum.upvoted([votes(t)], legacy).select("owner_id", "id", "subreddit", "permalink")


@query("flt_14_upvote_direction", f"""
    SELECT id, ([true, true, false, false, true, true, false])[seq % 7 + 1] AS up FROM v_upvoted""")
def _(t):
    return votes(t).select(F.col("thing_id").cast("long").alias("id"),
                           forum.is_upvote(F.col("vote_direction")).alias("up"))


@query("src_05_saved", f"""
    SELECT owner_id, CAST(id AS VARCHAR) AS id, subreddit, permalink, title, {AT} FROM v_saved
    UNION ALL SELECT owner_id, CAST(id AS VARCHAR), subreddit, permalink, NULL, {AT} FROM v_upvoted""")
def _(t):
    def rows(df):
        return df.select("owner_id", "seq", F.col("id").cast("string").alias("id"), "subreddit", "permalink",
                         "title", F.unix_millis("created_at").cast("string").alias("created"))
    return show(forum.saved([rows(t.saved())], rows(t.upvoted()))).drop("seq")


@query("src_06_subscriptions", "SELECT owner_id, subreddit AS name FROM v_comment")
def _(t):
    c = t.comments()
    return forum.subscriptions([c.select("owner_id", F.concat(F.lit("R/"), "subreddit").alias("name")),
                                c.select("owner_id", F.lit(" ").alias("subreddit"))])


def payload(t):
    body = F.base64(F.encode("text", "UTF-8"))
    url = F.regexp_replace(F.translate(body, "+/", "-_"), r"[\s=]", "")
    head = F.array(
        F.struct(F.lit("FROM").alias("name"), F.concat("contact", F.lit("@x.org")).alias("value")),
        F.struct(F.lit("to").alias("name"), F.lit("me@x.org, you@x.org").alias("value")),
        F.struct(F.lit("Subject").alias("name"), F.col("channel").alias("value")))
    part = F.struct(F.array(
        F.struct(F.struct(F.lit("ICA").alias("data")).alias("body")),
        F.struct(F.struct(url.alias("data")).alias("body"))).alias("parts"))
    return F.struct(F.array(F.struct(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"), F.lit(" sn ").alias("snippet"),
        F.unix_millis("created_at").cast("string").alias("internalDate"),
        F.struct(head.alias("headers"), F.array(part).alias("parts")).alias("payload"))).alias("messages"))


@query("src_07_mail_json", f"""
    SELECT owner_id, 'm' || event_id AS external_id, substr(trim('Subject: ' || channel || chr(10) || chr(10)
        || CASE WHEN trim(text, {TRIM}) = '' THEN '' ELSE trim(text, {TRIM}) || chr(10) || chr(10) END || 'sn', {TRIM}), 1, 6000) AS text, {AT},
        contact || '@x.org|me@x.org|you@x.org' AS people, contact = 'user_7' AS is_user_message FROM v_msg""")
def _(t):
    e = mail.json_events(raw(t.messages(), F.to_json(payload(t))), F.lit("user_7@"))
    return show(stored(e)).select("owner_id", "external_id", "text", "created_at",
                          F.array_join("participants", "|").alias("people"), "is_user_message")


@query("src_08_mbox", f"""
    SELECT owner_id, '<' || event_id || '@x>' AS external_id, substr('Subject: Café ' || channel || chr(10) || chr(10)
        || trim(replace(text, 'From ', 'from '), {TRIM}), 1, 6000) AS text, {AT} FROM v_msg""")
def _(t):
    m = t.messages()
    encoded = F.base64(F.encode(F.replace("text", F.lit("From "), F.lit("from ")), "UTF-8"))
    box = F.concat(
        F.lit("From x@y Thu Jan 1 00:00:00 2024\r\nFrom: "), "contact", F.lit("@x.org\r\nSubject:\r\n =?UTF-8?B?"),
        F.base64(F.encode(F.lit("Café"), "UTF-8")), F.lit("?= "), "channel", F.lit("\r\nMessage-ID: <"),
        F.col("event_id").cast("string"), F.lit("@x>\r\nDate: "),
        F.date_format("created_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(
            ' +0000\r\nContent-Type: multipart/mixed; boundary="BouNd"\r\n\r\n--BouNd\r\nContent-Type: text/html\r\n\r\n<b>no</b>\r\n'
            "--BouNd\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: base64\r\n\r\n"), encoded,
        F.lit("\r\n--BouNd--\r\n"))
    # Two copies of a file hold each message once: split as the reader would.
    pieces = raw(m, box, "'a.mbox'").withColumn("content", F.regexp_replace("content", "^From ", "")).withColumn(
        "seq", F.monotonically_increasing_id())
    return show(stored(mail.mbox_events(pieces))).select("owner_id", "external_id", "text", "created_at")


@query("src_28_any_mail", """SELECT owner_id, count(*) AS mails FROM v_msg GROUP BY 1""")
def _(t):
    m = t.messages()
    box = F.concat(F.lit("From a\nFrom: b\nSubject: "), "channel", F.lit("\n\nhello\n"))
    both = raw(m.filter("is_user_message"), F.to_json(payload(t))).unionByName(
        raw(m.filter("NOT is_user_message"), box))
    return mail.any_mail(both).groupBy("owner_id").agg(F.count(F.lit(1)).alias("mails"))


@query("src_09_social_csv", f"""
    SELECT owner_id, substr(trim(body, {TRIM}), 1, 6000) AS text, {AT}, subreddit AS channel,
        'p' || id AS external_id, CAST(score AS VARCHAR) AS score FROM v_comment WHERE trim(body, {TRIM}) <> ''""")
def _(t):
    rows = t.comments().select(
        "owner_id", "seq", "body", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("When"),
        F.col("subreddit").alias("Place"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("Key"),
        F.col("score").cast("string").alias("Points"))
    e = social_csv.events(rows, {"text": "body", "date": "When", "channel": "Place", "id": "Key"},
                          F.col("owner_id"))
    return show(stored(e)).select("owner_id", "text", "created_at", "channel", "external_id",
                          F.col("metadata")["Points"].alias("score"))


@query("src_10_csv_preview", "SELECT count(*) AS n FROM (SELECT * FROM documents LIMIT 5)")
def _(t):
    _, rows = social_csv.preview(t.raw("documents"), 5)
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("src_11_column_stats", r"""WITH c AS (
        SELECT 'doc_id' AS header, doc_id::VARCHAR AS v FROM documents UNION ALL SELECT 'text', trim(text) FROM documents
        UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents
        UNION ALL SELECT 'n_chars', n_chars::VARCHAR FROM documents UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d') FROM documents JOIN events ON doc_id = event_id
        UNION ALL SELECT 'link', 'https://x.org/' || doc_id FROM documents JOIN events ON doc_id = event_id)
    SELECT header, count(*) AS filled, round(avg(length(v)), 6) AS mean_length,
        avg(regexp_matches(regexp_replace(v, '\s+', '', 'g'), '^[0-9]+$')::INT) AS numeric_share,
        avg((header = 'day')::INT) AS date_share, max(regexp_matches(v, '(?i)^(https?://|www\.)')) AS has_link
    FROM c WHERE v <> '' GROUP BY header""")
def _(t):
    df = t._dated("documents", "doc_id").select(
        "doc_id", "text", "lang", "source", "n_chars", F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.concat(F.lit("https://x.org/"), F.col("doc_id").cast("string")).alias("link"))
    return social_csv.column_stats(df).drop("place").withColumn("mean_length", F.round("mean_length", 6))


def tree(t):
    """A bookmark folder per page: nested two levels deep."""
    leaf = F.struct(F.col("url").alias("url"), F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("name"),
                    F.col("us").cast("string").alias("date_added"), F.col("page_id").cast("string").alias("id"))
    folder = F.struct(F.lit("").alias("name"), F.array(F.struct(
        F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("name"), F.array(leaf).alias("children"))).alias("children"))
    return F.to_json(F.struct(F.struct(folder.alias("bar")).alias("roots")))


def timed_pages(t):
    return t._dated("pages", "page_id").select(
        t.owner("page_id"), "page_id", "url", "event_type", F.unix_micros("ts").alias("us"),
        F.col("ts").alias("created_at"))


PAGES = "(SELECT v.*, e.ts AS created_at, e.event_type, epoch_us(e.ts) AS us FROM v_page v JOIN events e ON e.event_id = page_id)"


@query("src_12_bookmarks", f"""
    SELECT owner_id, 'Bookmark: n' || page_id || chr(10) || url AS text, {AT}, page_id::VARCHAR AS external_id, url FROM {PAGES}
    UNION ALL SELECT owner_id, 'Bookmark: f' || page_id, NULL, NULL, NULL FROM {PAGES}""")
def _(t):
    p = timed_pages(t).withColumn("us", F.col("us") + F.lit(11_644_473_600_000_000))
    return show(stored(takeout.bookmarks(raw(p, tree(t))))).select("owner_id", "text", "created_at", "external_id", "url")


@query("src_13_browser_history", f"""
    SELECT owner_id, 'Visited: ' || event_type || chr(10) || url AS text, {AT}, page_id::VARCHAR AS external_id FROM {PAGES}
    UNION ALL SELECT owner_id, 'Visited page', NULL, NULL FROM {PAGES}""")
def _(t):
    visit = F.struct(F.col("event_type").alias("title"), "url", F.col("us").alias("time_usec"),
                     F.col("page_id").cast("string").alias("id"))
    doc = F.to_json(F.struct(F.array(visit).alias("Browser History")))
    return show(stored(takeout.history(raw(timed_pages(t), doc)))).select("owner_id", "text", "created_at", "external_id")


@query("src_14_discover_feed", f"""
    SELECT owner_id, CASE WHEN page_id % 2 = 0 THEN 'Discover ' ELSE 'Other ' END || event_type || chr(10) || url AS text, {AT}
    FROM {PAGES} WHERE page_id % 2 = 0 OR contains(lower(url), 'discover')""")
def _(t):
    item = F.struct(F.concat(F.when(F.col("page_id") % 2 == 0, "Discover ").otherwise("Other "), "event_type")
                    .alias("title"), F.col("url").alias("titleUrl"),
                    F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"))
    return show(stored(takeout.discover(raw(timed_pages(t), F.to_json(F.array(item)))))).select(
        "owner_id", "text", "created_at")


@query("src_15_activity_pages", f"""
    SELECT owner_id, 'Watched & ' || event_type || ' ' || strftime(created_at, '%b %-d, %Y, %-I:%M:%S %p') || ' UTC' || chr(10) || replace(url, '&amp;', '&') AS text,
        {AT}, replace(url, '&amp;', '&') AS url FROM {PAGES}""")
def _(t):
    cell = F.concat(
        F.lit('<div class="outer-cell"><div class="content-cell mdl">Watched &amp; <a href="'),
        F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">'), "event_type", F.lit("</a><br>"),
        F.date_format("created_at", "MMM d, yyyy, h:mm:ss a"), F.lit(" UTC</div></div><p>end</p>"))
    pages = raw(timed_pages(t), cell, "'watch-history.html'")
    pieces = pages.select("owner_id", "path", F.posexplode(F.split("content", "</div>")).alias("seq", "content"))
    return show(stored(takeout.activity_blocks(pieces, "youtube", F.lit("youtube")))).select(
        "owner_id", "text", "created_at", "url")


@query("src_15_activity_fallback", rf"""
    SELECT owner_id, page_id, length(substr(s, 1, 6000)) AS kept FROM (SELECT owner_id, page_id,
        replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(regexp_replace(
        html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '&nbsp;', ' '), '&amp;', '&'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS s FROM v_page) WHERE length(s) > 40""")
def _(t):
    pages = raw(t.pages(), F.col("html"), "cast(page_id as string)")
    out = stored(takeout.activity_fallback(pages, "discover", F.col("path")))
    return out.select("owner_id", F.col("channel").cast("long").alias("page_id"),
                      F.length("text").cast("long").alias("kept"))


# A thread per contact: its events in order, with sides.
THREAD = """(SELECT *, count(*) OVER (PARTITION BY owner_id, contact) AS n,
        count(*) FILTER (is_user_message) OVER (PARTITION BY owner_id, contact) AS mine FROM v_evt)"""


def threads(t):
    """Conversation pages; a contact of the fixture has a few hundred messages."""
    sender = F.when(F.col("is_user_message"), '<a class="tel" href="tel:+15550100"><abbr class="fn">Me</abbr></a>').otherwise(
        F.concat(F.lit('<a class="tel" href="tel:+15550199"><span class="fn">'), "contact", F.lit("</span></a>")))
    block = F.concat(
        F.lit('<div class="message"><abbr class="dt" title="'), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.lit('">x</abbr>: <cite class="sender vcard">'), sender, F.lit("</cite>: <q>a &lt; "),
        "channel", F.lit("<br>"), "text", F.lit("</q></div> "))
    pages = t.dense().groupBy("owner_id", "contact").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))), lambda s: s["b"]), "").alias("blocks"))
    return pages.select("owner_id", F.concat(F.lit("Voice/"), "contact", F.lit(".html")).alias("path"), F.concat(
        F.lit("<html><title>"), "contact", F.lit('</title><div class="hChatLog">'), "blocks",
        F.lit("</div></html>")).alias("content"))


@query("src_16_phone_messages", f"""
    SELECT owner_id, contact AS contact_name, CASE WHEN is_user_message THEN 'Me' ELSE contact END AS sender_name,
        CASE WHEN is_user_message THEN '+15550100' ELSE '+15550199' END AS phone, 'a < ' || channel || chr(10) || text AS text,
        is_user_message, {AT} FROM v_evt""")
def _(t):
    return show(takeout.sms_messages(threads(t))).drop("path", "seq")


@query("src_16_phone_events", f"""
    SELECT owner_id, contact AS contact_name, count(*) AS messages FROM {THREAD}
    WHERE n >= 3 AND mine >= 2 AND n - mine >= 2 GROUP BY ALL""")
def _(t):
    e = takeout.sms_events(takeout.conversations(takeout.sms_messages(threads(t))))
    return e.groupBy("owner_id", "contact_name").agg(F.count(F.lit(1)).alias("messages"))


@query("src_17_phone_json", f"""
    SELECT owner_id, CASE event_id % 3 WHEN 0 THEN substr(trim(text, {TRIM}), 1, 6000) WHEN 1 THEN contact || ' -> Me' ELSE 'Google Voice activity' END AS text, {AT},
        CASE event_id % 3 WHEN 1 THEN contact || '|Me' ELSE '' END AS people FROM v_evt
    WHERE NOT (event_id % 3 = 0 AND (regexp_matches(text, '\\{{\\s*[^}}]*:\\s*[^;]*;')))""")
def _(t):
    n = F.col("event_id") % 3
    doc = F.to_json(F.struct(
        F.when(n == 0, F.col("text")).alias("messageText"), F.when(n == 1, F.col("contact")).alias("from"),
        F.when(n == 1, F.lit("Me")).alias("to"), F.lit(True).alias("voicemail"),
        F.unix_millis("created_at").alias("timestamp")))
    return show(stored(takeout.voice(raw(t.dense(), doc)))).select(
        "owner_id", "text", "created_at", F.array_join("participants", "|").alias("people"))


@query("src_18_video_json", f"""
    SELECT owner_id, event_type || ' on YouTube' || chr(10) || 'Details: Ad, ' || page_id || chr(10) || url AS text, {AT},
        CASE WHEN page_id % 3 = 0 THEN 'youtube_music' ELSE 'youtube' END AS channel FROM {PAGES}""")
def _(t):
    item = F.struct(
        F.concat("event_type", F.lit(" on YouTube")).alias("title"), F.col("url").alias("titleUrl"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.when(F.col("page_id") % 3 == 0, "YouTube Music").otherwise("YouTube").alias("product"),
        F.array(F.struct(F.lit("Ad").alias("name")), F.struct(F.col("page_id").cast("string").alias("name")))
        .alias("details"))
    return show(stored(takeout.youtube(raw(timed_pages(t), F.to_json(F.array(item)))))).select(
        "owner_id", "text", "created_at", "channel")


@query("src_19_csv_rows", f"""
    SELECT owner_id, text, {AT}, contact || '|me' AS people, channel, event_id::VARCHAR AS external_id FROM v_evt""")
def _(t):
    row = F.create_map(
        F.lit("caption"), "text", F.lit("text"), F.lit(""), F.lit("timestamp"),
        F.unix_millis("created_at").cast("string"), F.lit("sender"), "contact", F.lit("recipient"), F.lit("me"),
        F.lit("platform"), "channel", F.lit("post_id"), F.col("event_id").cast("string"))
    rows = t.dense().select("owner_id", row.alias("row"), F.col("event_id").alias("position"))
    return show(stored(takeout.row_events(rows, "chrome", "chrome_history"))).select(
        "owner_id", "text", "created_at", F.array_join("participants", "|").alias("people"), "channel", "external_id")


FOLDERS = ["Chrome/Bookmarks.json", "Chrome/History.json", "Mail/a.mbox", "Voice/Calls/x.html", "YouTube/watch-history.html",
           "Discover/My Activity.html", "YouTube/voice history.csv", "Misc/readme.txt", "Gmail/mail history.json"]
ROUTES = ["chrome:bookmarks", "chrome:history", "gmail:mbox", "google_voice:sms", "youtube:activity", "discover:activity",
          "chrome:rows,google_voice:rows,youtube:rows", "", "chrome:history,gmail:mail_json"]


@query("src_20_routed_files", f"""
    SELECT doc_id, ([{", ".join(repr(r) for r in ROUTES)}])[doc_id % {len(FOLDERS)} + 1] AS routes FROM documents""")
def _(t):
    n = F.col("doc_id")
    path = F.concat(F.lit("/x/o/"), n.cast("string"), F.lit("/"), F.element_at(
        F.array(*[F.lit(f) for f in FOLDERS]), (n % len(FOLDERS) + 1).cast("int")))
    found = F.transform(takeout.routes(path), lambda r: F.concat_ws(":", r["family"], r["parser"]))
    return t.raw("documents").select("doc_id", F.array_join(F.array_sort(found), ",").alias("routes"))


@query("src_22_direct_messages", f"""
    SELECT owner_id, substr(text, 1, 6000) AS text, {AT}, 'Ana|' || contact AS people, contact_name, is_user_message FROM (
        SELECT *, 'chat with ' || event_id AS contact_name FROM v_msg WHERE trim(text, {TRIM}) <> '')""")
def _(t):
    doc = F.to_json(F.struct(
        F.array(F.struct(F.lit("Ana").alias("name")), F.struct(F.col("contact").alias("name"))).alias("participants"),
        F.array(F.struct(F.when(F.col("is_user_message"), "Ana").otherwise("Meta AI").alias("sender_name"),
                         F.unix_millis("created_at").alias("timestamp_ms"), F.col("text").alias("content")),
                F.struct(F.lit("Ana").alias("sender_name"), F.lit(5).cast("long").alias("timestamp_ms"),
                         F.lit(" ").alias("content"))).alias("messages")))
    e = instagram.messages(raw(t.messages(), doc, "concat('inbox/chat_with_', event_id, '/message_1.json')"))
    return show(stored(e)).select("owner_id", "text", "created_at", F.array_join("participants", "|").alias("people"),
                          "contact_name", "is_user_message")


@query("src_23_photo_comments", f"""
    SELECT owner_id, substr(text, 1, 2000) AS text, {AT}, 'http://p/' || event_id AS url, 'by ' || channel AS title
    FROM v_msg WHERE trim(text, {TRIM}) <> ''""")
def _(t):
    def item(upper):
        said = F.struct(F.col("text").alias("value"), F.floor(F.unix_micros("created_at") / 1_000_000).alias("timestamp"),
                        F.concat(F.lit("http://p/"), F.col("event_id").cast("string")).alias("href"))
        title = F.struct(F.concat(F.lit("by "), "channel").alias("value"))
        names = ("Comment", "Title") if upper else ("comment", "title")
        return F.struct(F.struct(said.alias(names[0]), title.alias(names[1])).alias("string_map_data"))
    doc = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.array(item(True)).alias("comments_media_comments")))
                 ).otherwise(F.to_json(F.struct(F.array(item(False)).alias("media_comments"))))
    e = instagram.comments(raw(t.messages(), doc, "'a/post_comments.json'"))
    return show(stored(e, 2000)).select("owner_id", "text", "created_at", "url", F.col("metadata")["postTitle"].alias("title"))


# Chats of the conversation table in each of the three export forms.
TURNS = "(SELECT *, 1700000000 + conv_id * 60 + turn AS s FROM v_chat WHERE role = 'user' AND length(text) >= 5)"
S = "strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at"


def seconds():
    return F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn")


def grouped(t, entry, wrap):
    """One document per conversation, its turns in order."""
    rows = t.chats().groupBy("owner_id", "conv_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda s: s["e"]).alias("turns"))
    return rows.select("owner_id", F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"),
                       wrap.alias("content"))


def mapping_docs(t, array=False):
    message = F.struct(F.struct(
        F.col("external_id").alias("id"), F.struct("role").alias("author"),
        F.struct(F.array(F.col("text")).alias("parts")).alias("content"),
        seconds().cast("double").alias("create_time")).alias("message"))
    keyed = F.map_from_entries(F.transform(F.col("turns"), lambda e: F.struct(e["message"]["id"].alias("k"), e)))
    doc = F.struct(keyed.alias("mapping"))
    return grouped(t, message, F.to_json(F.array(doc)) if array else F.to_json(doc))


def list_docs(t, nested=True):
    entry = F.struct("role", F.col("text").alias("content"), (seconds() * 1000).alias("timestamp"),
                     F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"))
    conv = F.struct(F.lit("n").alias("name"), F.col("turns").alias("messages"))
    doc = F.struct(F.array(conv).alias("conversations")) if nested else F.struct(F.col("turns").alias("messages"))
    return grouped(t, entry, F.to_json(doc))


@query("src_24_chat_mapping", f"""
    SELECT owner_id, external_id, substr(text, 1, 8000) AS text, {S}, 'chatgpt' AS channel FROM {TURNS}""")
def _(t):
    return show(stored(chat.mapping_turns(files.parsed(mapping_docs(t, True))), 8000)).select(
        "owner_id", "external_id", "text", "created_at", "channel")


@query("src_25_chat_messages", f"""
    SELECT owner_id, substr(text, 1, 8000) AS text, {S}, 'n' AS title FROM {TURNS}""")
def _(t):
    return show(stored(chat.message_turns(files.parsed(list_docs(t))), 8000)).select(
        "owner_id", "text", "created_at", F.col("metadata")["title"].alias("title"))


@query("src_26_any_chat", f"""
    SELECT owner_id, conv_id, turn, {S}, CASE conv_id % 3 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' ELSE 'm' || conv_id % 3 END AS channel
    FROM {TURNS}""")
def _(t):
    # Each conversation arrives in one of the three forms.
    n = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 3
    docs = mapping_docs(t).filter(n == 0).unionByName(list_docs(t).filter(n == 1)).unionByName(
        list_docs(t, False).filter(n == 2))
    e = chat.any_turns(docs)
    s = F.unix_seconds("created_at") - 1_700_000_000
    conv = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    return show(e.withColumn("conv_id", conv).withColumn("turn", s - conv * 60)).select(
        "owner_id", "conv_id", "turn", "created_at", "channel")


@query("src_29_rejected_json", """SELECT owner_id, count(*) AS files, count(*) FILTER (doc_id % 4 = 0) AS rejected
    FROM (SELECT doc_id, 'o' || doc_id % 3 AS owner_id FROM documents) GROUP BY 1""")
def _(t):
    d = t.raw("documents").select(t.owner("doc_id"), "doc_id", "text")
    content = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("{"), "text")).otherwise(F.to_json(F.struct("text")))
    return files.rejected(raw(d, content))


@query("fn_33_flattened_objects", """
    SELECT owner_id, count(*) * 3 AS objects, CAST(sum(length(text)) AS BIGINT) AS chars FROM v_chat GROUP BY 1""")
def _(t):
    doc = F.to_json(F.struct(F.lit(1).alias("a"), F.array(F.array(F.struct(
        F.struct(F.col("text").alias("said")).alias("inner")))).alias("b")))
    o = files.json_objects(raw(t.chats(), doc))
    return o.groupBy("owner_id").agg(F.count(F.lit(1)).alias("objects"), F.sum(F.length(F.col("strings")["said"])).alias("chars"))
