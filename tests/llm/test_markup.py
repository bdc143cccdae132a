import pytest
from pyspark.sql import functions as F

from feedloom.llm import markup as m

HTML = (("content_html", True),)


@pytest.mark.parametrize(
    "value, is_html, want",
    [
        (None, False, []), ("", True, []), ("Plain words, 5 < 6 and a > b.", False, []), ("It costs $5 and $6 today.", False, []), ("C:\\Temp\\x and snake_case_name", False, []), ("A tag (#Tag12) and #other", False, []), ("7 * 8 * 2 and a*b", False, []), ("AT&T and R&D", False, []),
        ("<p>x</p>", False, ["html"]), ("a&nbsp;b", False, ["html"]), ("<p>x</p>", True, []), ("x &lt; y", True, []),
        ("Some **bold** text", False, ["markdown"]), ("~~gone~~", True, ["markdown"]), ("See [this](https://x.example/y_z)", True, ["markdown"]), ("![a](b.png)", False, ["markdown"]), ("# Heading\n\ntext", True, ["markdown"]), ("use `code` here", False, ["markdown"]), ("```\nx = 1\n```", True, ["markdown"]), ("* one\n* two", True, ["markdown"]), ("[a][1]", True, ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", True, ["markdown"]),
        ("'''bold''' text", False, ["wiki"]), ("''it'' text", True, ["wiki"]), ("[[Page|label]]", True, ["wiki"]), ("{{box|a=1}}", False, ["wiki"]), ("== Head ==\ntext", True, ["wiki"]), ("[https://x.example label]", True, ["wiki"]), ("* [[A]]\n* [[B]]", True, ["wiki"]),
        (r"$c_{k} = \frac{1}{2}$", False, ["latex"]), (r"\emph{x} \cite{y}", True, ["latex"]), (r"\[\sum x\]", True, ["latex"]), (r"\(a \leq b\)", True, ["latex"]), (r"\begin{equation} x \end{equation}", False, ["latex"]), (r"$$\int_0^1 x\,dx$$", True, ["latex"]),
        ("<pre><code># no\nrows[[1, 2]] = f(**kw)\necho \"$HOME\" `x`\n</code></pre>", True, []), ("<p>**a** and \\emph{b}</p>", True, ["latex", "markdown"]), ("<a href=\"x__y__z\">t</a>", True, []),
    ],
)
def test_languages(value, is_html, want):
    assert m.languages(value, is_html) == want


def test_conversion_keeps_structure():
    html = "<h2>Head &amp; more</h2><p>One <b>two</b>\nthree</p><ul><li>a</li><li>b</li></ul><pre><code>x = 1\n  y</code></pre><p>Use <code>f(x)</code>.</p><script>no()</script>"
    assert m.to_text(m.tree(html)) == "## Head & more\nOne two three\n- a\n- b\n```\nx = 1\n  y\n```\nUse `f(x)`."
    assert m.to_text(m.tree("[[P|label]] and '''b''' and {{x|y}} **c** [d](e)")) == "label and b and c d"
    assert "$c_{k} = 1$" in m.to_text(m.tree(r"<p>\[c_{k} = 1\]</p>"))
    assert m.to_text(m.tree("")) == "" and m.to_text(m.tree("a < b")) == "a < b"
    deep = "<div>" * 20000 + "x"
    root = m.tree(deep)
    assert len(m.hash_subtrees(root)) == 20000 and m.to_text(root) == "x"


def test_equal_subtrees_have_equal_hashes():
    a, b = m.tree("<div class=a><p>x  y</p></div><p>z</p>"), m.tree("<p>q</p><div class=b><p>x y</p></div>")
    assert set(m.hash_subtrees(a)) & set(m.hash_subtrees(b)) and len(set(m.hash_subtrees(a)) & set(m.hash_subtrees(b))) == 2


def test_templates_are_removed(spark):
    rows = [(k, f"h{k % 2}.example", f"<p>Own text {k}</p><div><b>Share this</b></div>" + ("<p>rare</p>" if k < 5 else "")) for k in range(40)] + [(90, None, None), (91, "h0.example", ""), (92, None, "<p>alone</p>")]
    df = spark.createDataFrame(rows, "item_row bigint, h string, content_html string").selectExpr("*", "1 as host", "2 as gone", "3 as html")
    got = {r.item_row: (r.text, r.subtrees_removed) for r in m.method_texts(df, "item_row", F.col("h"), HTML).collect()}
    assert len(got) == 43 and got[7] == ("Own text 7", 2) and got[2] == ("Own text 2\nrare", 2)
    assert got[90] == (None, 0) and got[91] == ("", 0) and got[92] == ("alone", 0)
    assert m.method_texts(df.limit(0), "item_row", F.col("h"), HTML).count() == 0


def test_operator(spark):
    df = spark.createDataFrame([(1, "<p>**a**</p>", "<p>**a**</p>"), (2, None, ""), (3, "x" * 200_000, "$" * 50_000)], "item_row bigint, summary string, content_html string").selectExpr("*", "1 as field", "2 as markup")
    got = {tuple(r) for r in m.found_languages(df, "item_row", (("summary", False), ("content_html", True))).collect()}
    assert got == {(1, "summary", "html"), (1, "summary", "markdown"), (1, "content_html", "markdown")}


def test_summaries_come_out_as_clean_text(spark):
    import __spark_entry__ as entry

    for value, want in [
        ("<p>One <b>two</b> &amp; [three](https://x.example)</p>", "One two & three"),
        ("A '''b''' in [[P|label]]\nand \\emph{c} and **d**", "A b in label\nand c and d"),
        ("if a <b and c, see ?x=1&copy=2 & AT&T", "if a <b and c, see ?x=1&copy=2 & AT&T"),
        ("x <y> z and 3 < 4", "x <y> z and 3 < 4"),
        ("# Head\n\n* one\n* two", "# Head\n- one\n- two"),
    ]:
        assert m.to_text(m.plain_tree(value), lined=True) == want
    got = entry.queries()["p6_method"](spark, "/root/testdata/sf0.001")
    items = spark.read.parquet("/root/testdata/sf0.001/items.parquet")
    assert got.count() == got.select("item_row", "field").distinct().count() == 2 * items.count()
    both = got.where("field = 'summary'").join(items, "item_row")
    assert both.where("(text is null) <> (summary is null)").count() == 0
    assert both.where("summary like '%</p>%'").count() > 0 and both.where("text like '%</p>%'").count() == 0


def test_what_is_shown_counts(spark):
    """Pictures differ by their addresses, links without a text by their targets; links with a text by that alone."""
    same = lambda a, b: m._read(a, True).key == m._read(b, True).key
    assert not same("<p><img src='a.png' class=x></p>", "<p><img src='b.png' class=x></p>") and same("<p><img src='a.png' class=x></p>", "<p><img class=y src=a.png></p>")
    assert same("<a href=/1>Share</a>", "<a href=/2>Share</a>") and not same("<a href=/1><img src=x></a>", "<a href=/2><img src=x></a>")
    rows = [(k, f"<p>Own {k}</p><p><img src='/{k}.png'></p><p><img src='/logo.png'></p><p>a<br>b</p>", f"<div>Read more</div>Text {k}" if k % 2 else f"no elements {k}") for k in range(30)]
    df = spark.createDataFrame(rows, "item_row bigint, content_html string, summary string")
    got = {(r.item_row, r.field): (r.text, r.subtrees_removed) for r in m.method_texts(df, "item_row", F.lit("h"), (("content_html", True), ("summary", False))).collect()}
    assert len(got) == 60 and got[7, "content_html"] == ("Own 7", 4) and got[7, "summary"] == ("Text 7", 1) and got[8, "summary"] == ("no elements 8", 0)
    # the paragraph's break is kept where the paragraph stays
    few = spark.createDataFrame([(k, f"<p>Own {k}<br>b</p>", None) for k in range(12)], "item_row bigint, content_html string, summary string")
    assert {r.text for r in m.method_texts(few, "item_row", F.lit("h"), HTML).collect()} == {f"Own {k}\nb" for k in range(12)}


def test_ordinary_content_that_recurs_stays(spark):
    def page(k):
        return f"<h2>Summary</h2><p>Own {k} is <em>not</em> one<br>but two</p><table><tr><td>0</td><td>{k}</td></tr></table>" + (f"<p>rare {k // 15}</p>" if k < 15 else "") + "<div><b>Share this</b></div>"

    rows = [(k, k, page(k)) for k in range(2000)]
    rows += [(3000 + k, 2000, "<p>Delivered often</p><div><b>Share this</b></div>") for k in range(40)]
    rows += [(4000 + k, 4000 + k, "<p>Copied often</p><div><b>Share this</b></div>") for k in range(40)]
    df = spark.createDataFrame(rows, "item_row bigint, e bigint, content_html string")
    got = {r.item_row: r.text for r in m.method_texts(df, "item_row", F.lit("h"), HTML, entry=F.col("e")).collect()}
    assert got[20] == "## Summary\nOwn 20 is not one\nbut two\n0\n20"
    assert got[3] == "## Summary\nOwn 3 is not one\nbut two\n0\n3\nrare 0"
    assert {got[3000 + k] for k in range(40)} == {"Delivered often"} and {got[4000 + k] for k in range(40)} == {"Copied often"}
