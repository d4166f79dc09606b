"""Wrapped lists read step by step."""

import io
import json
import os
import resource

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidings.sources import io as IO
from tidings.sources import wrapped as W

value = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8),
                     lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=4), v, max_size=3), max_leaves=6)


def read(text, step=7):
    return list(W.elements(io.BytesIO(text.encode("utf-8", "surrogatepass")), step))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), value, max_size=3), max_size=6), st.integers(1, 40),
       st.sampled_from([None, 1]), st.booleans())
def test_elements_of_wrapped_lists(records, step, indent, ascii_only):
    text = json.dumps({"key": records}, indent=indent, ensure_ascii=ascii_only)
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert [(k, json.loads(v)) for k, v in read(text, step)] == [("record", r) for r in records]


@pytest.mark.parametrize("step", [1, 3, 1000])
@pytest.mark.parametrize("text,want", [
    ('{"a": 1, "b": [1, 2]}', [("record", '{"a": 1, "b": [1, 2]}')]),
    ('{"refers_to": ["x"], "link": "y"}', [("record", '{"refers_to": ["x"], "link": "y"}')]),
    ('{"k": []}', []), ('{"k": {"a": 1}}', [("broken", '{"k": {"a": 1}}')]), ("{}", [("broken", "{}")]),
    ('{"k": [{"a": 1}, 5, {"b": 2}]}', [("record", '{"a": 1}'), ("broken", "5"), ("record", '{"b": 2}')]),
    ('{"k": [{"a": 1}, {"b" 2}]}', [("record", '{"a": 1}'), ("broken", None)]),
    ('{"k": [{"a": 1}', [("record", '{"a": 1}'), ("broken", None)]),
    ("[1]", [("broken", None)]), ("no json", [("broken", None)]), ("", [("broken", None)])])
def test_files_of_every_kind(text, want, step):
    got = read(text, step)
    joined = [k for i, (k, _) in enumerate(got) if i == 0 or k != "broken" or got[i - 1][0] != "broken"]
    assert joined == [k for k, _ in want]
    for (k, v), (_, w) in zip(got, want):
        assert w is None or v == w


def test_a_long_list_is_read_in_bounded_memory(tmp_path):
    """200 MB under one key: the process grows by a few steps, not by the file."""
    path = tmp_path / "big.json"
    record = json.dumps({"link": "x", "text": "y" * 10_000})
    with open(path, "w") as f:
        f.write('{"source": [' + record)
        for _ in range(20_000):
            f.write("," + record)
        f.write("]}")
    assert os.path.getsize(path) > 200_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with W.open_stream(str(path)) as stream:
        assert sum(k == "record" for k, _ in W.elements(stream)) == 20_001
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50_000  # kB
    path.unlink()


def test_a_broken_start_does_not_gather_the_rest():
    text = '{"k": [{"a" 1}' + ', {"b": 2}' * 200_000 + "]}"
    assert max(len(v) for _, v in read(text, 1000)) < 5000


def test_both_readers_agree(spark, tmp_path):
    rec = {"link": "l", "text": "t", "title": "ü", "source": "s", "timestamp": "2024-01-01T00:00:00", "refers_to": ["a"]}
    files = {"a.json": {"s": [rec, rec | {"link": "m"}]}, "b.json": rec, "c.json": {"s": []}, "d.json": {"s": "no"}}
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content, ensure_ascii=False))
    (tmp_path / "e.json").write_text("not json")
    key = lambda df: sorted((os.path.basename(r.path), r.kind, r.value.replace(" ", "")) for r in df.collect())
    assert key(W.read_wrapped(spark, str(tmp_path), "*.json")) == key(W.read_whole(spark, str(tmp_path), "*.json"))
    records, broken = IO.scan_mixed_json(spark, str(tmp_path), "*.none", "*.json")
    assert sorted(r.link for r in records.collect()) == ["l", "l", "m"] and broken.count() == 2
