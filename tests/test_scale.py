"""Plans that carry numbers instead of texts, and joins that do not gather a hot group."""

import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from keepsake.functions.text import any_word, bounded
from keepsake.operators import clusters, contacts, questions, ranking, retrieval, sessions, training, voice
from keepsake.operators.contacts import events_with
from keepsake.operators.term_index import TermIndex
from keepsake.sources import json_cuts, takeout


def test_matches_are_ranked_without_their_texts(spark):
    texts = spark.createDataFrame([("o", i, f"word{i % 3} common {'x' * 50}", float(i)) for i in range(20)],
                                  "owner_id string, seq long, low string, base double")
    asked = spark.createDataFrame([("o", 1, ["word1", "common", "common"]), ("o", 2, ["word2"]), ("p", 3, ["common"])],
                                  "owner_id string, question_id int, terms array<string>")
    index = TermIndex(texts, ["owner_id"])
    found = retrieval.candidates(index, asked, ["base", "seq"], [F.desc("base"), F.asc("seq")], 2)
    assert set(found.columns) == {"owner_id", "question_id", "_row", "hits", "base", "seq"}
    got = sorted((r.question_id, r.seq, r.hits) for r in found.collect())
    want = [(1, i, 3 if i % 3 == 1 else 2) for i in range(20)] + [(2, i, 1) for i in range(20) if i % 3 == 2]
    # The two best by base that do not hold word2.
    assert got == sorted(want + [(2, 19, 0), (2, 18, 0)])
    shown = index.fetch(found.filter("question_id = 2 AND hits = 0").select("seq", "_row"), "low").collect()
    assert sorted((r.seq, r.low[:5]) for r in shown) == [(18, "word0"), (19, "word1")]


def test_a_part_of_many_names_keeps_one_contact(spark):
    contacts = spark.createDataFrame([("o", f"user_{i}", 1000 - i) for i in range(300)], "owner_id string, contact string, seq long")
    pieces = questions.contact_pieces(contacts)
    assert pieces.count() == pieces.select("owner_id", "piece").distinct().count()
    asked = spark.createDataFrame([("o", 1, "what of User_7 now"), ("o", 2, "any user"), ("o", 3, "nobody")],
                                  "owner_id string, question_id int, question string")
    got = {r.question_id: (r.contact, r.priority) for r in questions.named_contacts(asked, contacts).collect()}
    assert got == {1: ("user_7", 0), 2: ("user_299", 1)}


def test_lexical_hits_as_by_the_pattern_alone(spark):
    rng = random.Random(3)
    bits = ["don't", "dont", "a", "b", "A", "_", "'", " ", " ", ".", "K", "é", "\n", "ab", "9"]
    texts = [("o", i, 0, 0.0, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    phrases = ["a b", "don't a", "a", "'a b", "a a", "b ' a", "9 ab", "ab don't"]
    rows = spark.createDataFrame(texts, "owner_id string, seq int, place int, score double, text string")
    asked = spark.createDataFrame([("o", i, p) for i, p in enumerate(phrases)], "owner_id string, question_id int, phrase string")
    got = {(r.question_id, r.seq): r.occurrences for r in questions.lexical_hits(rows, asked).collect()}
    edge = bounded(r"\b")
    want = {}
    for q, p in enumerate(phrases):
        pattern = re.compile(edge + "[^A-Za-z0-9_]+".join(map(re.escape, p.split())) + edge, re.I | re.A)
        want |= {(q, i): n for _, i, _, _, t in texts if (n := len(pattern.findall(t)))}
    assert got == want
    assert spark.range(1).select(questions._plain_words(F.lit("AKb--c_D ")).alias("w")).first().w == " a b c_d "


def test_few_names_do_not_shuffle_events(spark):
    events = spark.range(50).selectExpr("'o' AS owner_id", "id AS seq", "array('Me', concat('src', id % 3)) AS participants")
    targets = spark.createDataFrame([("o", "src1"), ("o", "src")], "owner_id string, target string")
    found = events_with(events, targets)
    assert found.count() == 67 and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_are_found_as_by_both_edges(spark):
    words = ["the", "don't", "a_b", "9"]
    old = "(?i)" + bounded(rf"\b(?:{'|'.join(map(re.escape, words))})\b")
    new = any_word(words)
    assert new.count("(?<!") < old.count("(?<!")
    texts = [("The don't a_B",), ("xthe the_ éthe the-9",), ("9the 'don't' A_b.",), ("",), ("don'the",)]
    df = spark.createDataFrame(texts, "t string").select(*[F.regexp_count("t", F.lit(p)).alias(n) for p, n in ((old, "a"), (new, "b"))])
    assert all(r.a == r.b for r in df.collect())
    assert any_word(["it's", "'tis"]) == "(?i)" + bounded(rf"\b(?:{'|'.join(map(re.escape, ["it's", "'tis"]))})\b")


def test_batches_for_python_are_small(spark):
    from keepsake.session import configure
    assert int(configure(spark).conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_large_documents_of_an_archive_are_cut_once(spark, tmp_path, monkeypatch):
    def put(name, doc):
        at = tmp_path / "owner=ana" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(json.dumps(doc))

    put("Chrome/History.json", {"Browser History": [{"title": f"t{i}", "url": f"http://t.org/{i}"} for i in range(40)]})
    put("Chrome/Bookmarks.json", {"roots": {"bar": {"name": "", "children": [{"name": f"n{i}", "url": "http://n.org"} for i in range(40)]}}})
    put("Mail/all.json", {"messages": [{"id": str(i), "snippet": f"s{i}, {'x' * 20}"} for i in range(40)]})
    put("Voice/calls.json", [{"messageText": "short"}])
    put("Voice/other.txt", [])
    (tmp_path / "owner=ana" / "Voice" / "rows.csv").write_text("text\nrow\n")
    (tmp_path / "owner=ana" / "Voice" / "page.html").write_text("<p>none</p>")
    (tmp_path / "owner=ana" / "Mail" / "a.mbox").write_text("From x\n\nempty\n")
    cut, parts = [], json_cuts.parts
    monkeypatch.setattr(json_cuts, "parts", lambda *a: cut.append(1) or parts(*a))
    events = takeout.read_takeout(spark, str(tmp_path), largest=600).collect()
    found = Counter(re.sub(r"\d+", "", r.text.split("\n")[0]) for r in events if r.owner_id == "ana")
    assert len(cut) == 1
    # A root object counts as a page of its own.
    assert found["Visited: t"] == found["Bookmark: n"] == 40 and found["short"] == found["row"] == 1
    assert sum(r.source == "gmail" and r.text.startswith("s") for r in events) == 40
    few = int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism"))
    assert few == spark.sparkContext.defaultParallelism


def test_only_runs_of_frequent_pairs_are_counted(spark, monkeypatch):
    rng = random.Random(5)
    names = ["w%d" % i for i in range(12)] + ["the", "of"]
    texts = [("o%d" % (i % 2), " ".join(rng.choice(names) for _ in range(rng.randint(1, 30)))) for i in range(60)] + [("p", "a lone text of six words")]
    corpus = spark.createDataFrame(texts, "owner_id string, body string")
    stop = set(voice.STYLE_STOP_WORDS)
    want = {}
    for owner in {o for o, _ in texts}:
        count = Counter(" ".join(w[i:i + n]) for o, b in texts if o == owner for w in [b.split()] for n in (2, 3) for i in range(len(w) - n + 1))
        ranked = sorted(((p, c) for p, c in count.items() if not set(p.split()) <= stop), key=lambda x: (-x[1], x[0]))
        want[owner] = [(p, c, i + 1) for i, (p, c) in enumerate(ranked[:6])]

    def found():
        got = {}
        for r in voice.common_phrases(corpus, 6).orderBy("owner_id", "rank").collect():
            got.setdefault(r.owner_id, []).append((r.phrase, r["count"], r["rank"]))
        return got

    ranked, top_k = [], voice.top_k
    monkeypatch.setattr(voice, "top_k", lambda df, *a: ranked.append(df) or top_k(df, *a))
    assert found() == want
    triples = ranked[-1].filter("size(split(phrase, ' ')) = 3").count()
    assert 0 < triples < sum(max(0, len(b.split()) - 2) for _, b in texts) / 4
    # More frequent pairs than are broadcast: all runs are counted.
    monkeypatch.setattr(voice, "MAX_PAIRS", 0)
    assert found() == want


def test_messages_are_classified_once(spark):
    events = spark.createDataFrame([("o", "sms", ["Me", "a"], "see you on mon at the cafe"), ("o", "sms", ["Me", "b"], "see you on mon")],
                                   "owner_id string, source string, participants array<string>, text string")
    out = clusters.cluster_memory(events)
    assert "mon|tue" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.contact, r.message_count): list(r.top_phrases) for r in out.collect()}
    assert got == {("Me", 2): ["see you", "you mon"], ("a", 1): [], ("b", 1): []}


def test_few_phrases_are_tested_where_texts_are_read(spark, monkeypatch):
    rng = random.Random(7)
    letters = "ab'é \n\t"
    texts = [("o%d" % (i % 2), i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))) for i in range(120)] + [
        ("o0", 120, None), (None, 121, "a b"), ("o0", 122, "A B"), ("o0", 123, "a  b"), ("o0", 124, "a\nb"), ("o1", 125, "I say TBH a b")]
    phrases = ["a b", "aa b", "b 'a", "a b a", "a", "a  b", "! !", "to be honest", " ", None, "é a", "a b"]
    asked = [("o%d" % (i % 2), i // 3, p) for i, p in enumerate(phrases * 2)] + [(None, 1, "a b")]
    rows = spark.createDataFrame(texts, "owner_id string, seq int, text string").repartition(3)
    requests = spark.createDataFrame(asked, "owner_id string, question_id int, phrase string")
    terms = [(r.owner_id, r.question_id, r.terms) for r in questions.phrase_terms(requests).collect()]
    want = Counter((o, i, q) for o, i, t in texts for p, q, ts in terms if o is not None and o == p and t is not None
                   and any(x in t.lower() for x in ts if x.strip()))
    indexed = []
    monkeypatch.setattr(questions, "matching", lambda *a: indexed.append(1) or retrieval.matching(*a))
    found = questions.phrase_matches(rows, requests)
    assert found.columns == ["owner_id", "seq", "text", "question_id"] and not indexed
    assert Counter((r.owner_id, r.seq, r.question_id) for r in found.collect()) == want
    monkeypatch.setattr(questions, "MAX_PHRASES", 3)
    numbered = requests.withColumn("question_id", F.monotonically_increasing_id())
    want = {(o, i, r.question_id) for r in questions.phrase_terms(numbered).collect() for o, i, t in texts
            if o is not None and o == r.owner_id and t is not None and any(x in t.lower() for x in r.terms if x.strip())}
    found = [(r.owner_id, r.seq, r.question_id) for r in questions.phrase_matches(rows, numbered).collect()]
    assert indexed and len(found) == len(want) and set(found) == want


def test_two_words_are_looked_up_as_neighbours(spark):
    texts = spark.range(300).selectExpr("'o' AS owner_id", "concat('the of x', id, ' of  the\\tend') AS low")
    requests = spark.createDataFrame([("o", 1, ["of the"]), ("o", 2, ["he of", "none"]), ("o", 3, ["x7 o"]), ("o", 4, ["the\tend"])],
                                     "owner_id string, question_id int, terms array<string>")
    found = TermIndex(texts, ["owner_id"]).holding(requests, F.col("terms"))
    assert {r.question_id: r["count"] for r in found.groupBy("question_id").count().collect()} == {2: 300, 3: 1, 4: 300}


def test_chunks_and_their_messages_are_made_once(spark):
    rng = random.Random(9)
    events = spark.createDataFrame([("o", "sms", ["Me", "u%d" % (i % 3)], i, rng.randint(0, 4000), "t" * rng.randint(0, 3)) for i in range(300)],
                                   "owner_id string, source string, participants array<string>, seq long, minute long, text string").select(
        "*", F.timestamp_seconds(F.col("minute") * 600).alias("created_at"))
    table = sessions.chunks(events, min_messages=5, max_messages=8)
    inside = sessions.messages_in_chunks(table, sessions.prepare(events))
    plan = sessions.chunk_samples(inside)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("LogicalRDD") <= 1
    groups = {}
    for r in inside.select("owner_id", "chunk_id", "created_at", "seq", "text").collect():
        groups.setdefault((r.owner_id, r.chunk_id), []).append(r)
    want = set()
    for key, rows in groups.items():
        up = sorted(rows, key=lambda r: (r.created_at, r.seq))
        size = sorted(up, key=lambda r: -len(r.text))
        want |= {(*key, r.seq, p) for picks, at in ((up[:3], lambda i: i + 1), (up[::-1][:3], lambda i: 6 - i), (size[:2], lambda i: 7 + i))
                 for i, r in enumerate(picks) for p in (at(i),)}
    got = ranking.first_last_longest(inside, ["owner_id", "chunk_id"], ["created_at", "seq"], F.length("text"), 3, 3, 2)
    rows = [(r.owner_id, r.chunk_id, r.seq, r.picked) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(groups) > 20


def test_numbers_of_training_items_are_ranked(spark, monkeypatch):
    rows = [("o%d" % (i % 2), i, "s%d" % (i % 3), "word " * (i % 7 + 1) + ".", float(i % 5)) for i in range(60)] + [(None, 60, "s0", "none", 0.0)]
    slices = spark.createDataFrame(rows, "owner_id string, seq long, slice string, text string, score double")
    ranked, top_k = [], training.top_k
    monkeypatch.setattr(training, "top_k", lambda df, *a: ranked.append(df.columns) or top_k(df, *a))
    found = training.training_set(slices, 4)
    assert len(ranked) == 1 and "text" not in ranked[0]
    assert found.columns == ["owner_id", "seq", "slice", "text", "score", "quality", "rank"]
    every = training.training_set(slices).filter("rank <= 4").select(found.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, every.collect()), key=str)


def phone_page(title, *messages):
    def block(mine, said):
        who = '<abbr class="fn">Me</abbr>' if mine else '<a href="tel:+15550199"><span class="fn">L &amp; E</span></a>'
        return (f'<DIV id="1" class="message"><abbr class="dt" title="2024-01-05T10:00:00Z">x</abbr>:\r\n<CITE class="sender vcard">{who}\n'
                f"</CITE>: <Q>{said}</Q>\u2028</DIV>\n ")
    return f'<html><title> {title}\n</title><div class="hChatLog">{"".join(block(*m) for m in messages)}</div></html>'


def test_phone_messages_do_not_carry_their_page(spark):
    said = ["one\r\ntwo", "a<BR/>b &lt; \U0001f600", " \n", "\u2028line\u0085", "12345"]
    pages = spark.createDataFrame([("o", "a", phone_page("Lee", *[(i % 2 == 0, s) for i, s in enumerate(said)])),
                                   ("o", "b", phone_page(" ", (False, "<b>x</b>"))), ("o", "c", None), ("o", "d", "no page")],
                                  "owner_id string, path string, content string")
    found = takeout.sms_messages(pages)
    got = sorted((r.path, r.seq, r.contact_name, r.sender_name, r.phone, r.text, r.created_at.hour, r.is_user_message) for r in found.collect())
    me, other = ("Me", None), ("L & E", "+15550199")
    assert got == [("a", 0, "Lee", *me, "one\r\ntwo", 10, True), ("a", 1, "Lee", *other, "a\nb < \U0001f600", 10, False),
                   ("a", 3, "Lee", *other, "line\u0085", 10, False), ("a", 4, "Lee", *me, "12345", 10, True),
                   ("b", 0, None, *other, "<b>x</b>", 10, False)]
    # Above the explode nothing reads the page again, and no condition searches a block for sender and words again.
    above, _, _ = found._jdf.queryExecution().optimizedPlan().toString().partition("Generate")
    assert "content" not in above and "<cite" not in above and "<q>" not in above


def test_automated_messages_are_found_where_their_first_letters_are(spark):
    said = ["code: 1", "xcode: 1", "code:", "an otp.", "otps", "_otp", "order #a", "order #", "order # a", "your  order", "fraud\talert!", "é otp",
            "pre-shipped", "unshipped", "9delivered", "verify yours", "balance is", "abc", ""]
    rng = random.Random(3)
    words = [p.replace(r"\b", "").replace(r"\s*", " ").replace(r"\d+", "7") for p in contacts.SPAM_PATTERNS] + ["x", "_", "#", "é", "."]
    said += ["".join(rng.choice(words) + rng.choice(["", " ", "-", "_"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    rows = spark.createDataFrame([(s,) for s in said], "text string").select("text", contacts.is_spam(
        F.col("text"), F.lit("Lee"), F.lit(None).cast("string"), F.lit(3)).alias("spam")).collect()
    pattern = re.compile("|".join(contacts.SPAM_PATTERNS), re.ASCII)
    assert [r.spam for r in rows] == [pattern.search(r.text) is not None for r in rows]
    assert {True, False} == {r.spam for r in rows}


def test_pairs_of_words_are_shuffled_once(spark):
    texts = [("one two\x1cb three", ["Me", "A"]), ("ONE  two\u00a0x three\tone two\u00a0x", ["Me", "B", None]), ("one two\x1cb\nthree", ["Me", "A"]),
             ("of it", ["B"]), ("", ["Me"]), ("one two\u00a0x", ["A", "A"])]
    rows = spark.createDataFrame([("o", p, "other", t) for t, p in texts], "owner_id string, participants array<string>, cluster string, text string")
    found = clusters.cluster_phrases(rows)
    got = {(r.contact, r.phrase, r["count"]) for r in found.collect()}
    x, b = "two\u00a0x", "two\x1cb"
    assert got == {("Me", f"one {b}", 2), ("Me", f"{b} three", 2), ("Me", f"one {x}", 2), ("A", f"one {b}", 2), ("A", f"{b} three", 2),
                   ("A", f"one {x}", 2), ("B", f"one {x}", 2), (None, f"one {x}", 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("phrase") and len(re.findall(r"Aggregate \[", plan)) == 1 and len(re.findall(r"RepartitionByExpression", plan)) == 1
