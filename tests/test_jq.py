import json

import pytest

from feedloom.plans import jq

ITEM = {"id": "1", "title": "Hi", "url": None, "tags": ["go", "x"], "n": [3, 1, 2], "o": {"a": 1, "b": None}, "size": 2**63 - 1, "f": 1.0}


@pytest.mark.parametrize(
    "program, want",
    [
        (".", [ITEM | {"f": 1}]), (".title", ["Hi"]), (".tags[]", ["go", "x"]), ('select(.tags | index("go")) | .id', ["1"]), ('select(.tags | index("no")) | .id', []), ("[.id,.title][]", ["1", "Hi"]), ("[.id, .title] | @tsv", ["1\tHi"]),
        ('if .title == "Hi" then "y" elif .x then 2 else empty end', ["y"]), ("{title, url}", [{"title": "Hi", "url": None}]), ('{"a b": .id, (.title): 1, @text "k": 2}', [{"a b": "1", "Hi": 1, "k": 2}]), ("{a: (1,2)}", [{"a": 1}, {"a": 2}]), (".n | sort | map(. + 1) | add", [9]), (".x // \"d\"", ["d"]), ("false // null // 3", [3]),
        ("reduce .n[] as $x (0; . + $x)", [6]), ("[foreach .n[] as $x (0; . + $x)]", [[3, 4, 6]]), ("[foreach .n[] as $x (0; . + $x; . * 2)]", [[6, 8, 12]]), (".n[1:]", [[1, 2]]), (".n[-1]", [2]), (".title[1:]", ["i"]), ('"a\\(.title)b"', ["aHib"]), ('.title | test("h"; "i")', [True]), ('.title | gsub("(?<c>[A-Z])"; "\\(.c)-")', ["H-i"]), ('"aXbX" | sub("X"; "y")', ["aybX"]),
        ('"abac" | [match("a."; "g").string]', [["ab", "ac"]]), (".size", [2**63 - 1]), ("[limit(2; .n[])]", [[3, 1]]), ("first(.n[]), last(.n[])", [3, 2]), ('try error("e") catch .', ["e"]), (".a?.b?", [None]), ("[.n[] | select(. > 1)]", [[3, 2]]), (".n as [$a, $b] | $a + $b", [4]), (". as {id: $i, tags: [$t]} | [$i, $t]", [["1", "go"]]), ("[range(3)], [range(1; 3)]", [[0, 1, 2], [1, 2]]), (".o.a += 1 | .o", [{"a": 2, "b": None}]), (".o |= with_entries(.value |= tostring) | .o", [{"a": "1", "b": "null"}]),
        ("del(.n[0, 2]) | .n", [[1]]), ("[paths | length] | length", [15]), ('.tags | join("-")', ["go-x"]), ("@base64 \"x\\(.id)\"", ["xMQ=="]), ("[.n | group_by(. > 1)[] | length]", [[1, 2]]), (".n | min, max, (unique | length)", [1, 3, 3]), ("def f(x): x * 2; f(.n[0])", [6]), ("def f($a; $b): $a - $b; f(5; 3)", [2]), ("def fac: if . <= 1 then 1 else . * (. - 1 | fac) end; 5 | fac", [120]),
        ("1, 2 | . + 1", [2, 3]), ('has("title"), (.tags | has(5))', [True, False]), ("label $f | (1, break $f, 2)", [1]), ('"2024-01-15T12:00:00Z" | fromdate | todate', ["2024-01-15T12:00:00Z"]), ("tojson | fromjson | .id", ["1"]), ('walk(if type == "number" then . + 1 else . end) | .n', [[4, 2, 3]]), ("[.[] | numbers]", [[1, 2**63 - 1]]), ("[1, [2, [3]]] | flatten, flatten(1)", [[1, 2, 3], [1, 2, [3]]]), ("10 % 3, 7 / 2, -(1 + 2)", [1, 3.5, -3]), ('"a,b" | split(",")', [["a", "b"]]), ("[.tags[] | ascii_upcase]", [["GO", "X"]]), ("{} | .a.b[1] = 3", [{"a": {"b": [None, 3]}}]), ("..|strings", None), ("[.n[] as $x | $x * 2]", [[6, 2, 4]]), ("@html \"\\(\"<a>\")\", (\"a b\" | @uri)", ["&lt;a&gt;", "a%20b"]), ("[1,2] | @csv, @json", ["1,2", "[1,2]"]), ("null | not, length", [True, 0]), ("[true, false] | any, all", [True, False]), (". == ., (1 < \"a\")", [True, True]), ("limit(0; 1)", []),
    ],
)
def test_programs(program, want):
    got = [json.loads(jq.dumps(v)) for v in jq.Program(program).run(ITEM)]
    if want is not None:
        assert got == want
    else:
        assert isinstance(got, list)


@pytest.mark.parametrize("bad", ["[", ".a |", "nope", "$x", "{a:}", '"abc', ".a as $x", "1 +", "if . then 1", "reduce . as $x (1)", "a b", "(", ".[", "1 == 2 == 3"])
def test_syntax_errors_before_anything_runs(bad):
    with pytest.raises(ValueError, match="no jq program"):
        jq.Program(bad)


@pytest.mark.parametrize("bad", [".title.x", ".[0]", '.title + 1', "error", "1 / 0", '.tags | keys | .[0] | .a', "{} | keys[0] + 1 | .x.y | error"])
def test_runtime_errors(bad):
    with pytest.raises(jq.JqError):
        list(jq.Program(bad).run(ITEM))


def test_columns_agree_with_the_interpreter(spark):
    from feedloom.schema import ITEM_FIELDS

    rows = [("1", 'q"uo\te\\', ["go"], None), ("2", None, None, "https://e.example/"), ("3", "", [], "é\n\u2028"), ("4", "click", ["x", "go"], "<&>")]
    base = spark.createDataFrame(rows, "id string, title string, tags array<string>, url string").selectExpr("*", "0 as feed_idx", "1 as page", "cast(id as int) as pos")
    kinds = {"_feed": "struct<feed_url string, home_page_url string, title string>", "attachments": "array<struct<url string>>", "authors": "array<struct<name string>>"}
    for f in ITEM_FIELDS:
        if f not in base.columns:
            base = base.selectExpr("*", f"cast(null as {kinds.get(f, 'string')}) as {f}")
    for p in (".", ".title", ".url // .id", "{title, url}", '{"u": .url, "a": {"b": .id}}', "[.id, .title, .url] | @tsv", 'select(.tags | index("go")) | .id', 'select(.title == "click" or .url != null) | .title', 'select(has("url") | not)', 'select(.title) | .id', "._feed.title", '"x"'):
        fast = jq.apply(base, p)
        assert "MapInArrow" not in fast._jdf.queryExecution().toString(), p
        slow = jq.apply(base, p, columns=False)
        assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())), p
    assert [r.value for r in jq.raw(jq.apply(base, ".title")).orderBy("pos").collect()][:2] == ['q"uo\te\\', "null"]
