"""Sources and sinks on small files written here."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidings.sources import io as IO

RECORD = "link string, text string, title string, source string, timestamp timestamp_ntz, refers_to array<string>"


def news(spark, links):
    return spark.createDataFrame([(x, "t", "t", "s", dt.datetime(2024, 1, 1), []) for x in links], RECORD)


def test_reading_news_twice_and_mixed_files_after(spark, tmp_path):
    path = str(tmp_path / "news")
    IO.write_news(news(spark, ["http://a.org/1"]).withColumn("id", F.lit(1).cast("long")), path)
    for _ in range(2):
        assert [r.link for r in IO.read_news(spark, path).collect()] == ["http://a.org/1"]
    assert IO.read_mixed_json(spark, path, "*.json", "*.none").count() == 1


def test_broken_files_go_to_quarantine(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"link": "l1"}\n\nnot json\n{"link": "l2"}\n')
    (tmp_path / "wrapped.json").write_text('{"src": [{"link": "l3"}, {"link": "l4"}]}')
    (tmp_path / "single.json").write_text('{"link": "l5", "title": "t"}')
    (tmp_path / "broken.json").write_text('{"link": "l6"')
    (tmp_path / "odd.json").write_text('{"src": 7}')
    (tmp_path / "empty.json").write_text("{}")
    records, broken = IO.scan_mixed_json(spark, str(tmp_path))
    assert sorted(r.link for r in records.collect()) == ["l1", "l2", "l3", "l4", "l5"]
    assert sorted((r.path.split("/")[-1], r.value) for r in broken.collect()) == [
        ("a.jsonl", "not json"), ("broken.json", '{"link": "l6"'), ("empty.json", "{}"), ("odd.json", '{"src": 7}')]


def test_append_gives_following_ids_and_keeps_rejects(spark, tmp_path):
    table = str(tmp_path / "table")
    first = IO.append_news(news(spark, ["http://a.org/1", "http://a.org/2", "bad"]), table)
    second = IO.append_news(news(spark, ["http://a.org/0"]), table)
    assert [sorted(r.id for r in x.collect()) for x in (first, second)] == [[0, 1], [2]]
    assert spark.read.parquet(table).count() == 3
    assert [(r.link, r.reason) for r in spark.read.parquet(table + "_rejected").collect()] == [("bad", "bad url link")]


def test_a_replayed_batch_takes_its_own_place(spark, tmp_path):
    table = str(tmp_path / "table")
    IO.append_news(news(spark, ["http://a.org/1", "http://a.org/2"]), table, batch=0)
    for _ in range(2):
        IO.append_news(news(spark, ["http://a.org/3"]), table, batch=1)
    assert sorted((r.id, r.link) for r in spark.read.parquet(table).collect()) == [
        (0, "http://a.org/1"), (1, "http://a.org/2"), (2, "http://a.org/3")]


def test_an_unreadable_table_is_an_error(spark, tmp_path):
    table = tmp_path / "table"
    (table / "batch=0").mkdir(parents=True)
    (table / "batch=0" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        IO.append_news(news(spark, ["http://a.org/1"]), str(table))


def test_profiles_merge_onto_stored_codes(spark):
    stored = spark.createDataFrame(
        [("u1", 5, 7, "READY", 3, ["09.1", "02.2", "05.3"]), ("u2", 2, 8, "NEW", 1, ["11.1"]), ("u3", 4, 9, "READY", 1, [])],
        "id string, seq long, chat_id int, state string, last_message_id int, okveds array<string>")
    changes = spark.createDataFrame(
        [("u1", 6, None, "01.1", False), ("u2", 3, None, None, True), ("u2", 4, "READY", "03.3", False),
         ("u4", 1, None, "04.4", False)], "id string, seq long, state string, add_okved string, reset_okveds boolean")
    got = {r.id: (r.seq, r.state, r.chat_id, r.okveds) for r in IO.merge_profiles(stored, changes).collect()}
    assert got == {"u1": (6, "READY", 7, ["09.1", "02.2", "05.3", "01.1"]), "u2": (4, "READY", 8, ["03.3"]),
                   "u3": (4, "READY", 9, []), "u4": (1, "NEW", None, ["04.4"])}


def test_related_codes_are_normalised(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"1.1": ["02.3.", " 47 . 1 "], "62": ["1"]}\n')
    got = sorted(tuple(r) for r in IO.read_related_codes(spark, str(tmp_path)).collect())
    assert got == [("01.1", "02.3"), ("01.1", "47.1"), ("62", "01")]


def test_checkpoint_folder_is_asked_for_on_a_cluster(spark):
    from tidings import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
