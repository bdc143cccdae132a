import random
import re

from pyspark.sql import functions as F

from feedloom.llm import site_lines


def text_of(line):
    return re.sub(r"[ \t\r\n]+", " ", re.sub(r"<[^>]*>", "", line)).strip(" ")


def brute(rows, least=10):
    seen = {}
    for r, s, h in rows:
        for line in (h or "").split("\n"):
            t = text_of(line)
            if re.search(r"[^\W_]", t):
                seen.setdefault((s, t), set()).add(r)
    return {(r, k) for r, s, h in rows for k, line in enumerate((h or "").split("\n")) if len(seen.get((s, text_of(line)), ())) >= least}


def make(seed):
    rng = random.Random(seed)
    foot = ["<p>Share  this with a friend who still reads feeds.</p>", "<small>\t© Site. All rights reserved.</small>", "By the desk", "***", "", "Issue {} of the letter sent to all of our readers"]
    rows = []
    for r in range(120):
        body = [f"Body {rng.randrange(10**6)} text {k}" for k in range(rng.randrange(3))]
        own = [f.format(r) for f in foot if rng.random() < 0.3]
        rows.append((r, rng.choice([0, 0, 1, None]), rng.choice(["\n", "\r\n"]).join(own + body + own[:1]) if rng.random() < 0.95 else rng.choice([None, ""])))
    return rows


def test_repeated_against_brute_force(spark):
    rows = make(1)
    df = spark.createDataFrame(rows, "item_row bigint, feed_idx int, content_html string").selectExpr("*", "1 as scope", "'x' as text", "2 as b0")
    found = site_lines.lines(df, "item_row", "feed_idx", "content_html")
    got = [tuple(r) for r in site_lines.repeated(found).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_whole_clusters_go(spark):
    rows = [(r, 0, f"Own words {'abcdefghijklmnopqrst'[r]}\nIssue {r} of the letter that is sent to all of our readers on every working day") for r in range(20)]
    df = spark.createDataFrame(rows, "item_row bigint, feed_idx int, content_html string")
    found = site_lines.lines(df, "item_row", "feed_idx", "content_html")
    assert site_lines.repeated(found).count() == 0  # no text of its own recurs
    drop = site_lines.candidates(found).select("row_id", "line_no")
    out = site_lines.removed(df, drop, "item_row", "content_html").collect()
    assert len(out) == 20 and all(r.content_html.startswith("Own") and "Issue" not in r.content_html and r.lines_removed == 1 for r in out)


def test_empty(spark):
    df = spark.createDataFrame([], "item_row bigint, feed_idx int, content_html string")
    assert site_lines.repeated(site_lines.lines(df, "item_row", "feed_idx", "content_html")).count() == 0


def test_a_line_in_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("item_row"), (F.col("id") % 3).cast("int").alias("feed_idx"), F.when(F.col("id") % 3 == 0, F.lit("same line here")).otherwise(F.concat(F.lit("other "), F.sha2(F.col("id").cast("string"), 256))).alias("content_html"))
    assert site_lines.repeated(site_lines.lines(df, "item_row", "feed_idx", "content_html")).count() == 1000
