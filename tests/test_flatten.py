import json

from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.operators import flatten

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(JSON, JSON)
def test_identity_is_equality(a, b):
    same = json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    assert (flatten.identity(a) == flatten.identity(b)) is same


def test_identity_ignores_key_order_and_depth():
    assert flatten.identity({"a": 1, "b": [2]}) == flatten.identity({"b": [2], "a": 1})
    deep = x = {}
    for _ in range(5000):
        x["k"] = x = {}
    assert len(flatten.identity(deep)) == 16


BODY = {
    "version": "1",
    "authors": [{"name": "feed"}],
    "items": [
        {"id": "1", "tags": ["a", None, "", "a"], "authors": [None, {}, {"name": "A"}], "author": {"name": "B"}, "_x": {"tags": ["no"]}, "attachments": {"url": "u"}},
        {"id": "2", "tags": "solo", "authors": [{}, None], "author": {"name": "B"}},
        None,
        {"id": "3", "author": {}, "authors": [], "attachments": [{}, {"url": "u"}], "tags": []},
        "odd",
    ],
}
WANT = {(0, "tag", 0), (0, "tag", 3), (0, "author", 2), (0, "attachment", 0), (1, "tag", 0), (1, "author", 0), (3, "attachment", 1)}


def test_rows(spark):
    docs = [
        (1, json.dumps(BODY).encode()),
        (2, b"\xef\xbb\xbf" + json.dumps(BODY).encode()),
        (3, b"[1]"), (4, b"{"), (5, None), (6, b""), (7, b'{"items": {"tags": "x"}}'), (8, b'{"a": NaN}'), (9, b"\xff{}"), (10, b'{"items":[{"tags":["\\ud800"], "n": ' + b"9" * 5000 + b"}]}"), (11, b"[" * 100000), (12, b'{"tags":["no"],"a":' * 60000 + b"1" + b"}" * 60000),
        (13, b'{"items":[{"tags":["deep"],"x":' + b"[" * 60000 + b"1" + b"]" * 60000 + b"}]}"),
    ]
    df = spark.createDataFrame(docs, "page_row bigint, body binary").selectExpr("*", "1 as doc", "'x' as canon")
    occ = flatten.occurrences(df).cache()
    got = {tuple(r) for r in flatten.bridges(occ).where("child in ('author','tag','attachment')").select("doc", "item_pos", "child", "child_pos").collect()}
    assert got == {(d, *w) for d in (1, 2) for w in WANT} | {(10, 0, "tag", 0), (13, 0, "tag", 0)}
    assert occ.where("doc = 12").count() == 60000 and occ.where("doc = 12 and parent is null").count() == 1
    nodes = {r.canon: r.occurrences for r in flatten.nodes(occ.where("doc < 3")).collect()}
    # author B counts as an author once in each document; where authors are given it is an object like any other
    assert nodes['{"name":"B"}'] == 4 and nodes['"a"'] == 4 and nodes['{"url":"u"}'] == 4 and nodes['{"tags":["no"]}'] == 2
    assert occ.where("child = 'author' and canon like '%B%' and doc = 1").count() == 1
    # every bridge's parent is an item, and every occurrence has its node
    items = {r.node for r in occ.where("child = 'item'").collect()}
    assert all(r.parent in items for r in occ.where("child in ('author','tag','attachment')").collect())
    tables = flatten.flat_tables(occ)
    assert {r.tag for r in tables["tags"].where("page_row = 1").collect()} == {"a", "solo"}
    assert {r.name for r in tables["authors"].where("page_row = 2").collect()} == {"A", "B"}


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from(["items", "a", "_x", "authors"]), st.lists(st.dictionaries(st.sampled_from(["tags", "author", "authors", "attachments", "n"]), JSON, max_size=4), max_size=3) | JSON, max_size=4))
def test_documents_can_be_built_again(feed):
    rows = list(flatten.rows_of(1, feed))
    canon = {r[7].hex(): r[8] for r in rows}
    at = {r[1]: r for r in rows}
    assert len(at) == len(rows) and all(r[2] is None or at[r[2]][7] == r[6] for r in rows)  # every parent is an occurrence

    def build(v):
        if isinstance(v, dict):
            return build(json.loads(canon[v["$node"]])) if set(v) == {"$node"} else {k: build(x) for k, x in v.items()}
        return [build(x) for x in v] if isinstance(v, list) else v

    assert build(json.loads(rows[0][8])) == feed
    # objects that are equal are one node, those that differ are two
    assert len({r[8] for r in rows}) == len({r[7] for r in rows})


@settings(max_examples=300, deadline=None)
@given(JSON, st.text(alphabet='{}[]",: 1e.-tn\\u0', max_size=12))
def test_the_deep_reader_reads_what_the_other_reads(value, odd):
    for text in (json.dumps(value), json.dumps(value, indent=1), odd):
        try:
            want = json.loads(text, parse_constant=flatten._reject)
        except ValueError:
            try:
                raise AssertionError((text, flatten._loads_deep(text)))
            except ValueError:
                continue
        assert flatten._loads_deep(text) == want


def test_numbers_keep_their_digits():
    big = flatten.load_object(b'{"a":' + b"9" * 5000 + b',"b":1e999,"c":1.5}')
    text = flatten.subtrees(big)[1]
    assert text == '{"a":' + "9" * 5000 + ',"b":1E+999,"c":1.5}'


def test_empty_and_arrays(spark):
    none = spark.createDataFrame([], "page_row bigint, body binary")
    assert flatten.nodes(flatten.occurrences(none)).count() == 0
    t = spark.createDataFrame([(1, ["a", None, ""]), (2, None), (3, [])], "item_row bigint, tags array<string>")
    assert [(r.item_row, r.child_pos, r.tags) for r in flatten.explode_members(t, "item_row", "tags").collect()] == [(1, 0, "a")]
