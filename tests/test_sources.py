"""Export files written here and read back."""

import json

import pytest
from pyspark.sql import functions as F

from keepsake.functions import times
from keepsake.operators.contacts import contact_profiles
from keepsake.sources import chat, files, forum, instagram, mail, social_csv, takeout

def owner():
    return F.lit("ana")


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else json.dumps(text).encode())


def test_forum_folder_with_missing_files(spark, tmp_path):
    put(tmp_path, "comments.csv", 'id,subreddit,permalink,body,date,score\n'
        'c1,r/tea,/t/1,"two\nlines, ""quoted""",2024-01-05 10:00:00 UTC,3\n\n,tea,,plain,1704448800,\n')
    put(tmp_path, "comment_votes.csv", "id,permalink,direction\nv1,/a,up\nv2,/b,down\nv3,/c,1\n")
    put(tmp_path, "upvoted.csv", "id,title\nu1,old\n")
    put(tmp_path, "subscribed_subreddits.csv", "subreddit\nr/tea\nr/tea\n \n")
    t = forum.read_forum_export(spark, str(tmp_path), "ana")
    c = t["comments"].orderBy("seq").collect()
    assert (c[0].id, c[0].subreddit, c[0].body, c[0].score) == ("c1", "tea", 'two\nlines, "quoted"', 3.0)
    assert c[1].id.startswith("comment-comments.csv-") and c[1].score is None
    assert c[0].created_at == c[1].created_at
    assert {r.id for r in t["upvoted"].collect()} == {"v1", "v3", "u1"}
    assert [r.name for r in t["subreddits"].collect()] == ["tea", "tea"]
    assert t["posts"] is None and t["saved"] is None


def test_time_edges(spark):
    def ms(expr, *values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return [r[0] for r in df.select(F.unix_millis(expr("v"))).collect()]

    assert ms(times.forum_date, "9999999999", "10000000000", "", "junk") == [
        9999999999000, 10000000000, None, None]
    assert ms(times.chat_date, "1000000000000", "1000000000001") == [None, 1000000000001]
    assert ms(times.takeout_date, "1000000000000000", "1000000000000001") == [None, 1000000000000]
    assert ms(times.plain_date, "Tue, 5 Mar 2024 10:00:00 +0100 (CET)", "Jan 5, 2024, 1:02:03 PM UTC",
              "2024-01-05T13:02:03Z") == [1709629200000, 1704459723000, 1704459723000]


BOX = (
    "From a@x Thu Jan  4 10:00:00 2024\r\nFrom: =?utf-8?q?J=C3=B6rg?= <j@x.org>\r\nTo: me@x.org,\r\n you@x.org\r\n"
    "Subject: =?UTF-8?B?Q2Fmw6k=?=\r\n again\r\nDate: Thu, 4 Jan 2024 10:00:00 +0000\r\nMessage-ID: <1@x>\r\n"
    "Content-Transfer-Encoding: quoted-printable\r\n\r\nlong=\r\n line =3D ok\r\n"
    "\r\nFrom b@x Fri Jan  5 10:00:00 2024\r\nFrom: b@x.org\r\nContent-Type: multipart/alternative;\r\n boundary=\"AbC\"\r\n"
    "\r\n--AbC\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: base64\r\n\r\naGVsbG8=\r\n--AbC\r\n"
    "Content-Type: text/html\r\n\r\n<b>hello</b>\r\n--AbC--\r\n")


def test_mail_folder(spark, tmp_path):
    put(tmp_path, "m/a.mbox", BOX)
    put(tmp_path, "m/b.json", [{"id": "g1", "internalDate": "1704362400000", "snippet": "s", "payload": {
        "headers": [{"name": "FROM", "value": "c@x"}], "parts": [{"body": {}}, {"body": {"data": "aGk_"}}]}}])
    rows = {r.external_id: r for r in mail.read_mail(spark, str(tmp_path), owner()).collect()}
    first = rows["<1@x>"]
    assert first.text == "Subject: Café again\n\nlong line = ok"
    assert first.participants == ["Jörg <j@x.org>", "me@x.org", "you@x.org"]
    assert rows[None].text == "hello" and rows["g1"].text == "hi?\n\ns"


def message(stamp, mine, text):
    who = ('<a href="tel:+15550100"><abbr class="fn">Me</abbr></a>' if mine
           else '<a href="tel:+15550199"><span class="fn">Lee</span></a>')
    return (f'<div class="message"><abbr class="dt" title="2024-01-0{stamp}T10:00:00Z">x</abbr>: '
            f'<cite class="sender vcard">{who}</cite>: <q>{text}</q></div> ')


def page(title, *messages):
    return f'<html><title>{title}</title><div class="hChatLog">{"".join(messages)}</div></html>'


def takeout_tree(root):
    put(root, "Chrome/Bookmarks.json", {"roots": {"bar": {"name": "", "children": [
        {"name": "dir", "children": [{"name": "deep", "url": "http://d.org", "date_added": "13348800000000000"}]}]}}})
    put(root, "Chrome/History.json", {"Browser History": [
        {"title": "T", "url": "http://t.org", "time_usec": 1704362400000000}]})
    put(root, "Chrome/broken history.json", "{not json")
    put(root, "My Activity/Discover/MyActivity.html",
        '<div class="content-cell a">Read &amp; <a href="http://n.org?a=1&amp;b=2">n</a><br>Jan 5, 2024, 1:02:03 PM UTC</div>')
    put(root, "YouTube/watch-history.json", [
        {"title": "Watched", "titleUrl": "http://youtube.com/1", "time": "2024-01-05T00:00:00Z", "details": [{"name": "Ad"}]}])
    two = [message(i, i % 2 == 0, f"hello {i}") for i in range(1, 6)]
    put(root, "Voice/Calls/Lee.html", page("Lee", *two, message(6, False, "your order shipped")))
    put(root, "Voice/Calls/short.html", page("Kim", *two[:2]))
    put(root, "Voice/Calls/bank.html", page("Chase Bank", *two))
    put(root, "Voice/notes.csv", "text,from,timestamp\nnote,Lee,1704362400\n,,\n")
    put(root, "Mail/a.mbox", BOX)


def test_takeout_tree(spark, tmp_path):
    takeout_tree(tmp_path)
    events = takeout.read_takeout(spark, str(tmp_path), owner()).cache()
    counts = {r.source: r.events for r in takeout.takeout_counts(events).collect()}
    # A history document counts as a page besides its visits; a watch history is a history as well.
    assert counts == {"chrome": 5, "discover": 1, "youtube": 1, "sms": 5, "google_voice": 1, "gmail": 2}
    deep = events.filter(F.col("text").startswith("Bookmark: deep")).first()
    assert deep.created_at.year == 2024
    seen = events.filter("source = 'discover'").first()
    assert seen.url == "http://n.org?a=1&b=2" and seen.text.startswith("Read & n Jan 5, 2024")


def test_profiles_from_threads(spark, tmp_path):
    takeout_tree(tmp_path)
    raw = takeout.routed(files.read_whole(spark, str(tmp_path), "*.html", owner())).filter("parser = 'sms'")
    kept = takeout.conversations(takeout.sms_messages(raw))
    p = contact_profiles(kept.withColumn("contact", F.col("contact_name"))).collect()
    # Built before automated messages drop out, as the counts show.
    assert [(r.contact, r.messages, r.contact_name) for r in p] == [("Lee", 6, "Lee")]


def test_chat_forms(spark, tmp_path):
    node = {"message": {"id": "x", "author": {"role": "user"}, "content": {"parts": ["hello there"]},
                        "create_time": 1704362400.5}}
    put(tmp_path, "a.json", [{"mapping": {"1": node, "2": {"message": None}}}])
    put(tmp_path, "b.json", {"conversations": [{"name": "n", "created_at": "2024-01-04T10:00:00Z", "messages": [
        {"role": "user", "content": "good morning"}, {"role": "assistant", "content": "not mine"},
        {"role": "user", "content": "hey"}]}]})
    put(tmp_path, "c.json", {"messages": [{"role": "user", "content": {"text": "plain text"}, "date": 1704362400}]})
    rows = chat.any_turns(files.read_whole(spark, str(tmp_path), "*.json", owner())).collect()
    assert sorted((r.channel, r.text) for r in rows) == [
        ("chatgpt", "hello there"), ("claude", "good morning"), ("unknown", "plain text")]
    assert {r.created_at.strftime("%Y-%m-%d %H") for r in rows} == {"2024-01-04 10"}


def test_instagram_folder(spark, tmp_path):
    put(tmp_path, "inbox/lee_kim/message_1.json", {"participants": [{"name": "Lee"}, {"name": "Ana"}], "messages": [
        {"sender_name": "Lee", "timestamp_ms": 1704362400000, "content": "hi"}, {"sender_name": "Ana", "timestamp_ms": 5}]})
    raw = files.read_whole(spark, str(tmp_path), "*.json", owner())
    r = instagram.messages(raw).collect()
    assert [(x.text, x.contact_name, x.is_user_message) for x in r] == [("hi", "lee kim", True)]
    assert not instagram.messages(raw, "Ana").first().is_user_message


def test_mapping_is_inferred(spark):
    known = spark.createDataFrame([("1", "hi there", "2024-01-05", "Lee")], "msg_id string, message string, sent_at string, sender string")
    assert social_csv.infer_mapping(known) == {
        "text": "message", "date": "sent_at", "author": "sender", "id": "msg_id"}
    blind = spark.createDataFrame(
        [("2024-01-05", "a longer piece of writing", "7"), ("2024-01-06", "another longer one", "8")],
        "c1 string, c2 string, c3 string")
    found = social_csv.infer_mapping(blind)
    assert (found["text"], found["date"], found["id"]) == ("c2", "c1", "c3")


def test_files_below_every_folder_are_found(spark, tmp_path):
    put(tmp_path, "owner=ana/x/y/a.json", {})
    put(tmp_path, "owner=bo/b.json", {})
    rows = files.read_whole(spark, str(tmp_path), "*.json").collect()
    assert {r.owner_id for r in rows} == {"ana", "bo"}


def test_mail_parts_at_any_depth(spark):
    import base64
    import json

    part = {"body": {"data": base64.urlsafe_b64encode("deep text".encode()).decode().rstrip("=")}}
    for _ in range(60):
        part = {"body": {}, "parts": [{"body": {"data": ""}}, part]}
    doc = json.dumps([{"id": "m", "payload": part}])
    raw = spark.createDataFrame([("a", "mail.json", doc)], "owner_id string, path string, content string")
    assert [r.text for r in mail.json_events(raw).collect()] == ["deep text"]


def test_oversized_documents_fail_loudly(spark):
    raw = spark.createDataFrame([("a", "x.json", "[1, 2, 3]"), ("a", "y.json", "no json")],
                                "owner_id string, path string, content string")
    assert [r.doc is None for r in files.parsed(raw).orderBy("path").collect()] == [False, True]
    with pytest.raises(Exception, match="too large to parse"):
        files.parsed(raw, largest=8).collect()


def test_rows_come_in_slices():
    assert [len(x) for x in files.in_slices(iter(range(10)), 4)] == [4, 4, 2]
    assert list(files.in_slices(iter([]), 4)) == []


def test_events_of_two_imports_may_share_numbers(spark):
    from keepsake.operators.contacts import events_with

    rows = [("o", 0, ["Me", "Ana Lee"], "first"), ("o", 0, ["Ana Lee", "Me"], "second"), ("o", 0, ["Ana", "Ana Lee"], "both names")]
    events = spark.createDataFrame(rows, "owner_id string, seq long, participants array<string>, text string")
    targets = spark.createDataFrame([("o", "ana")], "owner_id string, target string")
    assert sorted(r.text for r in events_with(events, targets).collect()) == ["both names", "first", "second"]


def test_shared_folder_is_required_on_clusters():
    from types import SimpleNamespace

    from keepsake.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
