import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm import warc


def brute(rows, least):
    by = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least and i is not None:
            by[h] = max(by.get(h, i), i)
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        first = by.get(h) if len(data) >= least else None
        revisit = first is not None and first != i
        out.append((i, u, "revisit" if revisit else "response", first if revisit else None, len(data), hashlib.sha1(data).hexdigest(), None if revisit else h or ""))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def pages(spark):
    big, bigger = "<p>é😀\r\n\r\n</p>" * 90, "x" * 200_000
    rows = [(i, f"https://Www.{'abc'[i % 3]}.example.com:80/p/{i % 40}?q=ü#f{i}", (big, bigger, f"<b>{i}</b>", "", None, "y" * 999)[i % 6]) for i in range(200)]
    rows += [(None, None, big), (None, "not a url\nat all", bigger), (7, rows[7][1], rows[7][2]), (500, "http://user@host/%0A", "z" * 1000), (501, "", "z" * 1000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).repartition(5)


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    made = warc.write_archives(warc.captures(df), f"file://{tmp_path}/a", partitions=4, block_lines=16)
    got = [tuple(r) for r in warc.read_archives(made).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 1000), key=key)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("*.warc.gz")))
    assert sum(1 for _ in warc._members(raw)) == len(rows)
    keys = [(r["first_key"], r["last_key"]) for r in made.collect()]
    assert all(a <= b for a, b in keys) and len(keys) > 8


def test_lookup_equals_filter(spark, tmp_path):
    rows, df = pages(spark)
    made = warc.write_archives(warc.captures(df), f"file://{tmp_path}/b", partitions=4, block_lines=4)
    asked = spark.createDataFrame([(rows[3][1],), (rows[44][1],), ("not a url\nat all",), ("http://nowhere.example/x",), ("",), (None,)], "url string")
    got = sorted((r["key"], r["page_id"] or -1) for r in warc.lookup(asked, made).collect())
    all_keys = df.select(warc.url_key(F.col("url")).alias("k"), "page_id").collect()
    wanted = {r["k"] for r in asked.select(warc.url_key(F.col("url")).alias("k")).collect()}
    assert got == sorted((r["k"], r["page_id"] or -1) for r in all_keys if r["k"] in wanted)


def test_blocks_close_by_bytes_and_hot_urls_spread(spark, tmp_path):
    rows = [(i, "https://hot.example/%41?a=%0A", f"{i} " + "x" * 50_000) for i in range(120)] + [(1000 + i, f"https://cold.example/{i}", "c" * 3_000_000) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.write_archives(warc.captures(df), f"file://{tmp_path}/d", partitions=3, block_bytes=1 << 20)
    assert made.where("first_key like 'example,hot%'").count() >= 6 and made.agg(F.max("n")).first()[0] <= 21
    got = sorted((r["page_id"], r["url"]) for r in warc.lookup(df, made).collect())
    assert got == sorted((r[0], r[1]) for r in rows)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "d").glob("*.warc.gz")))
    heads = [m.split(b"\r\n\r\n")[0].decode() for m in warc._members(raw)]
    assert len({re.search("WARC-Record-ID: (.*)", h).group(1) for h in heads}) == len(rows)
    # any reader sees the URL as it was captured
    assert sum("WARC-Target-URI: https://hot.example/%41?a=%0A\r" in h for h in heads) == 120
    revisits = [h for h in heads if "WARC-Type: revisit" in h]
    assert len(revisits) == 3 and all("WARC-Refers-To-Target-URI: https://cold.example/3\r" in h for h in revisits)


def test_lookup_of_all_pages_reads_all(spark, tmp_path):
    rows, df = pages(spark)
    made = warc.write_archives(warc.captures(df), f"file://{tmp_path}/e", partitions=4, block_lines=5)
    got = [tuple(r) for r in warc.lookup(df, made).drop("key").collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 1000), key=key)


def test_empty_table(spark, tmp_path):
    _, df = pages(spark)
    made = warc.write_archives(warc.captures(df.limit(0)), f"file://{tmp_path}/c")
    assert made.count() == 0 and warc.read_archives(made).count() == 0
