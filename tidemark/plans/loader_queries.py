"""Provider documents, publication journals, replays and exact decimals over driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import exact_decimal
from tidemark.operators import planning, requests, temporal
from tidemark.plans.inputs import BARS, CUTOFF, REVISIONS, bars, month_ends, read, revisions
from tidemark.plans.registry import query
from tidemark.plans.temporal_queries import heads_sql
from tidemark.sources import formats, loaders, reading
from tidemark.sources.journal import Journal, payload_of, publish_once, recover
from tidemark.sources.storage import Chain, get_raw, put_raw, scratch


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("a12_receipted_exports", "SELECT l_returnflag AS name, count(*) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS claimed, count(*) AS held, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'whole' END AS state FROM lineitem GROUP BY 1 UNION ALL SELECT 'Z', 5, 0, 'absent'")
def a12(spark, d):
    """Gzipped CSVs read with the receipts that name them; one is short, one isn't there."""
    li, root = read(spark, d, "lineitem").select("l_returnflag", "l_orderkey"), scratch(spark)
    li.write.partitionBy("l_returnflag").options(header=True, compression="gzip").csv(root)
    claims = li.groupBy(F.col("l_returnflag").alias("name")).agg((F.count("*") + F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))).alias("claimed"))
    claims = claims.unionByName(spark.sql("SELECT 'Z' AS name, 5L AS claimed"))
    files = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv.gz").schema("l_orderkey long").csv(root)
    held = files.select(F.regexp_extract(F.col("_metadata.file_path"), "l_returnflag=([^/]+)/", 1).alias("name"))
    return loaders.reconciled(held, claims, "name")


@query("a13_two_tables", "SELECT 'order' AS kind, o_custkey AS token, o_orderkey AS id, o_orderpriority AS label FROM orders UNION ALL SELECT 'link', o_custkey, o_orderkey, 'F' FROM orders WHERE o_orderstatus = 'F'")
def a13(spark, d):
    """One JSON document a customer, two arrays in it, two tables out."""
    o = read(spark, d, "orders")
    link = F.when(F.col("o_orderstatus") == "F", F.struct(F.col("o_orderkey").alias("id"), F.lit("F").alias("label")))
    docs = o.groupBy(F.col("o_custkey").alias("token")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))).alias("orders"), F.collect_list(link).alias("links"))).alias("raw"))
    first, second = loaders.two_tables(docs, "raw", ("orders", "struct<id:bigint,label:string>"), ("links", "struct<id:bigint,label:string>"), ["token"])
    return first.withColumn("kind", F.lit("order")).unionByName(second.withColumn("kind", F.lit("link"))).select("kind", "token", "id", "label")


def _layouts(spark, d) -> dict[str, str]:
    """The orders' totals as a third each in the three layouts of public series."""
    roots = {name: scratch(spark) for name in ("series.csv", "series.response", "series.parts")}
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("day"), F.round("o_totalprice").alias("value"))
    third = lambda i: o.where(F.col("o_orderkey") % 3 == i).drop("o_orderkey")
    texts = F.when(F.col("value") % 10 == 0, ".").otherwise(_text(F.col("value").cast("bigint")))
    third(0).select("series", _text("day").alias("day"), texts.alias("value")).write.options(header=True, quote="").csv(roots["series.csv"])
    third(1).groupBy("series", "day").agg(F.collect_list(F.struct("day", "value")).alias("observations")).select("series", "observations").write.json(roots["series.response"])
    third(2).write.parquet(roots["series.parts"])
    return roots


_SERIES = "(SELECT o_orderkey % 3 AS i, o_orderpriority AS series, round(o_totalprice) AS value FROM orders)"


@query("a16_public_layouts", f"SELECT series, count(*) AS n, CAST(sum(CASE WHEN i = 0 AND value % 10 = 0 THEN NULL ELSE value END) AS DOUBLE) AS total FROM {_SERIES} GROUP BY 1")
def a16(spark, d):
    rows = None
    for name, root in _layouts(spark, d).items():
        one = loaders.LOADERS[name].read(spark, root)
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("k5_legacy_loaders", f"SELECT CASE i WHEN 0 THEN 'series.csv' WHEN 1 THEN 'series.response' ELSE 'series.parts' END AS loader, count(*) AS n, count(CASE WHEN i = 0 AND value % 10 = 0 THEN NULL ELSE value END) AS present FROM {_SERIES} GROUP BY 1")
def k5(spark, d):
    """Each layout through the registry, with what it held."""
    out = None
    for name, root in _layouts(spark, d).items():
        one = loaders.load(spark, name, root).agg(F.lit(name).alias("loader"), F.count("*").alias("n"), F.count("value").alias("present"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a17_company_headers", "SELECT 'CIK' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '.json' AS member, CASE WHEN o_custkey % 9 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS cik, CASE WHEN o_custkey % 9 <> 0 THEN max(CAST(o_orderdate AS DATE)) END AS latest, CASE WHEN o_custkey % 9 = 0 THEN 'not_an_object' END AS fault FROM orders GROUP BY o_custkey")
def a17(spark, d):
    k = F.col("o_custkey")
    dates = F.collect_list(F.date_format("o_orderdate", "yyyy-MM-dd"))
    filings = F.struct(F.struct(dates.alias("filingDate")).alias("recent"))
    docs = read(spark, d, "orders").groupBy(k).agg(F.to_json(F.struct(_text(k).alias("cik"), filings.alias("filings"))).alias("raw"))
    raw = docs.select(F.concat(F.lit("CIK"), F.lpad(_text(k), 10, "0"), F.lit(".json")).alias("member"), F.when(k % 9 == 0, "[1]").otherwise(F.col("raw")).alias("raw"))
    read_ = loaders.company_headers(raw, "raw", ["member"])
    ok = F.col("fault").isNull()
    return read_.select("member", F.when(ok, F.col("cik")).alias("cik"), F.when(ok, F.col("latest").cast("date")).alias("latest"), "fault")


@query("a19_html_table", "SELECT l_orderkey, CASE WHEN l_orderkey % 10 <> 0 THEN CAST(l_linenumber AS VARCHAR) END AS line, CASE WHEN l_orderkey % 10 <> 0 THEN l_returnflag || ' & ' || l_linestatus END AS flag, CASE WHEN l_orderkey % 10 = 0 THEN 'other_header' END AS fault FROM lineitem")
def a19_html(spark, d):
    """A listing's download as the HTML table it is; every tenth has another header."""
    row = F.concat(F.lit("<TR class=x><td> "), _text("l_linenumber"), F.lit("</td>\n<td><b>"), F.col("l_returnflag"), F.lit("</b>\n &amp;  "), F.col("l_linestatus"), F.lit("</td></TR>"))
    docs = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(row), "\n").alias("body"))
    head = F.when(F.col("l_orderkey") % 10 == 0, "<tr><th>number</th><th>flag</th></tr>").otherwise("<tr><th>line</th><th>flag</th></tr>")
    pages = docs.select("l_orderkey", F.concat(F.lit("<table>"), head, "body", F.lit("</table>")).alias("html"))
    return loaders.html_table(pages, "html", ["line", "flag"], ["l_orderkey"]).drop("place")


@query("a19_xml_records", "SELECT c_custkey, CAST(c_custkey * 10 AS VARCHAR) AS code, CAST(c_nationkey AS INTEGER) AS nation, c_mktsegment AS name FROM customer")
def a19_xml(spark, d):
    body = F.concat(F.lit("<list><code>"), _text(F.col("c_custkey") * 10), F.lit("</code><nation>"), _text("c_nationkey"), F.lit("</nation><name>"), F.col("c_mktsegment"), F.lit("</name></list>"))
    return loaders.xml_records(read(spark, d, "customer").select("c_custkey", body.alias("xml")), "xml", "code string, nation int, name string", ["c_custkey"])


@query("a19_index_lines", "SELECT o_custkey, CASE WHEN ok THEN CAST(o_custkey AS VARCHAR) END AS cik, CASE WHEN ok THEN o_orderstatus END AS form, CASE WHEN ok THEN CAST(o_orderdate AS DATE) END AS filed, CASE WHEN NOT ok THEN o_custkey || '|x|' || o_orderkey END AS text FROM (SELECT *, o_orderkey % 6 <> 0 AS ok FROM orders WHERE o_custkey % 8 <> 0)")
def a19_index(spark, d):
    """Daily index files, a customer's each; some without the rule below the header."""
    k = F.col("o_custkey")
    line = F.concat_ws("|", _text(k), F.lit("Name"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("edgar/data/"), _text(k), F.lit("/"), _text("o_orderkey"), F.lit(".txt")))
    line = F.when(F.col("o_orderkey") % 6 == 0, F.concat(_text(k), F.lit("|x|"), _text("o_orderkey"))).otherwise(line)
    docs = read(spark, d, "orders").groupBy(k).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    head = F.concat(F.lit("Description: index\n\nCIK|Company Name|Form Type|Date Filed|File Name\n"), F.when(k % 8 == 0, "--").otherwise("-" * 40), F.lit("\n"))
    return loaders.index_lines(docs.select(k, F.concat(head, "body").alias("raw")), "raw", ["o_custkey"]).select("o_custkey", "cik", "form", "filed", "text")


@query("a20_verified_jobs", "SELECT CASE WHEN o_custkey % 10 = 0 THEN 'unverified_job' WHEN o_orderkey % 7 = 0 THEN 'bad_value' ELSE 'row' END AS state, count(*) AS n FROM orders GROUP BY 1")
def a20(spark, d):
    """A provider's job, verified against its completion, as rows and rows held back."""
    k = F.col("o_custkey")
    rows = read(spark, d, "orders").select(_text(k).alias("job"), _text("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(_text("o_orderkey")).alias("value"))
    claims = rows.groupBy("job").agg(F.count("*").alias("claimed")).withColumn("claimed", F.col("claimed") + F.when(F.col("job").cast("long") % 10 == 0, 1).otherwise(0))
    good, held = loaders.verified_job(rows, claims, "job", {"id": "bigint", "value": "double"})
    states = good.select(F.lit("row").alias("state")).unionByName(held.select(F.col("reason").alias("state")))
    return states.groupBy("state").agg(F.count("*").alias("n"))


@query("a30_reference_rows", f"WITH {REVISIONS} SELECT 'heads' AS part, count(*) AS n, round(sum(value), 4) AS total FROM {heads_sql()} UNION ALL SELECT 'revisions', count(*), round(sum(value), 4) FROM revisions")
def a30(spark, d):
    """Another dataset's rows as a mapper reads them: its heads, or all its revisions, in the
    columns asked for."""
    from tidemark.plans.inputs import INGESTED

    r = revisions(spark, d)
    parts = {"heads": requests.read(r, requests.HeadRequest(CUTOFF, INGESTED)).select("value"), "revisions": r.select("value")}
    sums = [rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")) for name, rows in parts.items()]
    return sums[0].unionByName(sums[1])


_LINE = ["l_orderkey", "l_linenumber"]


@query("b4_published_documents", "SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS sequence, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def b4(spark, d):
    """Typed JSON documents published one after the other; publishing one again adds nothing."""
    root = scratch(spark)
    chain, journal = Chain(spark, f"{root}/chain"), Journal(spark, f"{root}/journal")
    raw = read(spark, d, "lineitem").select("l_returnflag", F.to_json(F.struct(*_LINE)).alias("raw"))
    for parent, flag in enumerate(("A", "N", "R")):
        rows = raw.where(F.col("l_returnflag") == flag).select(F.from_json("raw", "l_orderkey bigint, l_linenumber int", {"mode": "FAILFAST"}).alias("x")).select("x.*")
        for _ in range(2):
            publish_once(chain, journal, f"import-{flag}", rows, _LINE, parent)
    return chain.read().groupBy("sequence").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("total"))


@query("b10_run_envelopes", f"""WITH {BARS} SELECT instrument, n, sha256('{{"asset":' || instrument || ',"points":[' || points || ']}}') AS digest FROM (SELECT instrument, count(*) AS n, string_agg('["' || strftime(day, '%Y-%m-%d') || '",' || n || ']', ',' ORDER BY day) AS points FROM bars GROUP BY 1)""")
def b10(spark, d):
    """The canonical JSON document of a run's days, by asset, and its digest."""
    point = F.struct("day", F.concat(F.lit('["'), F.date_format("day", "yyyy-MM-dd"), F.lit('",'), _text("n"), F.lit("]")).alias("t"))
    per = bars(spark, d).groupBy("instrument").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(point)), lambda p: p["t"]), ",").alias("points"))
    text = F.concat(F.lit('{"asset":'), _text("instrument"), F.lit(',"points":['), "points", F.lit("]}"))
    return per.select("instrument", "n", F.sha2(text.cast("binary"), 256).alias("digest"))


@query("i24_generation_verdicts", "SELECT event_id % 5 + 1 AS sequence, event_id % 5 + 1 <> 4 AS link_ok, event_id % 5 + 1 <> 2 AS rows_ok, event_id % 5 + 1 NOT IN (2, 3) AS digest_ok FROM events GROUP BY event_id % 5")
def i24(spark, d):
    """A chain replayed: one generation lost a row, one had a value changed, one names another parent."""
    columns = ["event_id", "user_id"]
    rows = read(spark, d, "events").select((F.col("event_id") % 5 + 1).alias("sequence"), *columns)
    first = rows.groupBy("sequence").agg(F.min("event_id").alias("event_id")).withColumn("_first", F.lit(True))
    parent = F.when(F.col("sequence") == 4, 2).when(F.col("sequence") > 1, F.col("sequence") - 1)
    markers = requests.receipts(rows, columns, ["sequence"]).withColumn("parent", parent)
    marked = rows.join(first, ["sequence", "event_id"], "left")
    stored = marked.where("NOT (sequence = 2 AND _first IS NOT NULL)").withColumn("user_id", F.when((F.col("sequence") == 3) & F.col("_first").isNotNull(), F.col("user_id") + 1).otherwise(F.col("user_id")))
    return temporal.generation_verdicts(markers, stored, columns)


@query("i29_research_inputs", f"WITH {BARS} SELECT 'prices' AS input, count(*) AS n FROM bars UNION ALL SELECT 'sessions', count(DISTINCT day) FROM bars UNION ALL SELECT 'proxies', count(*) FROM (SELECT DISTINCT instrument, last_day(day) FROM bars) UNION ALL SELECT 'observations', count(*) FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) FROM orders)")
def i29(spark, d):
    """Four kinds of research input, each transformed from pinned rows and published once."""
    root, b = scratch(spark), bars(spark, d)
    inputs: dict[str, DataFrame] = {
        "prices": b.select("instrument", "day", "close"), "sessions": b.select("day").distinct(), "proxies": month_ends(spark, d).select("asset", "as_of", "close"),
        "observations": read(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.max("o_totalprice").alias("value")),
    }
    journal, out = Journal(spark, f"{root}/journal"), None
    for name, rows in inputs.items():
        chain = Chain(spark, f"{root}/{name}")
        publish_once(chain, journal, f"register-{name}", rows, rows.columns, 0)
        one = chain.read().agg(F.lit(name).alias("input"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("j8_recovered_operations", "SELECT 'completed' AS operation, 'published' AS outcome, count(*) FILTER (WHERE l_returnflag = 'A') AS n FROM lineitem UNION ALL SELECT 'uncompleted', 'published', count(*) FILTER (WHERE l_returnflag = 'N') FROM lineitem UNION ALL SELECT 'unwritten', 'published', count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem UNION ALL SELECT 'outrun', 'superseded', 0")
def j8(spark, d):
    """Crashes at each step of a publication: after the marker, before the rows, and after another
    writer took the place. Recovery tells them apart and every payload is there once."""
    root = scratch(spark)
    chain, journal = Chain(spark, f"{root}/chain"), Journal(spark, f"{root}/journal")
    rows = {f: read(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(*_LINE) for f in "ANR"}
    publish_once(chain, journal, "completed", rows["A"], _LINE, 0)
    pay = {f: payload_of(r, _LINE) for f, r in rows.items()}
    journal.prepare("uncompleted", {"parent": 1, "payload": pay["N"]})
    chain.publish(rows["N"], 1, pay["N"])  # and no completion
    journal.prepare("unwritten", {"parent": 2, "payload": pay["R"]})  # and no rows
    journal.prepare("outrun", {"parent": 1, "payload": pay["R"]})
    recover(chain, journal)
    publish_once(chain, journal, "unwritten", rows["R"], _LINE, 2)  # the retry
    sequence = {"completed": 1, "uncompleted": 2, "unwritten": 3, "outrun": None}
    table = spark.createDataFrame([(o, journal.outcome(o), s) for o, s in sequence.items()], "operation string, outcome string, sequence long")
    held = chain.read().groupBy("sequence").agg(F.count("*").alias("n"))
    return table.join(held, "sequence", "left").select("operation", "outcome", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("k2_trial_evaluator", "SELECT p_partkey AS trial, CAST(p_size * 2 + 1 AS DOUBLE) AS score, p_size % 3 <> 0 AS usable FROM part")
def k2(spark, d):
    trials = read(spark, d, "part").select(F.col("p_partkey").alias("trial"), F.col("p_size").alias("lookback"))
    return planning.evaluate_trials(trials, _scored, "trial long, score double, usable boolean")


def _scored(trial: dict) -> dict:
    return {"trial": trial["trial"], "score": trial["lookback"] * 2.0 + 1, "usable": trial["lookback"] % 3 != 0}


@query("k3_decimals_with_fallback", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN CAST(o_orderkey * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(38,12)) ELSE CAST(o_orderkey || '.250000000001' AS DECIMAL(38,12)) END AS value FROM orders")
def k3(spark, d):
    """Exact decimals: plain text in SQL, exponents in Python, text that loses digits refused."""
    k = F.col("o_orderkey")
    text = F.when(k % 11 == 0, F.concat(_text(k), F.lit(".1234567890123"))).when(k % 10 == 0, F.concat(_text(k), F.lit("e-3"))).otherwise(F.concat(_text(k), F.lit(".250000000001")))
    return read(spark, d, "orders").select(k, exact_decimal(text).alias("value"))


def _files(spark, contents: dict[str, bytes]) -> DataFrame:
    """Files as a ``binaryFile`` read gives them, from a table of fixed size."""
    return spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "path string, content binary")


@query("a4_sqlite_import", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def a4(spark, d):
    """A closed SQLite file, one table of it; the bytes are opened in memory on the executor."""
    import sqlite3

    own = [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in read(spark, d, "nation").collect()]  # 25 rows
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE nations (id INTEGER, name TEXT, region INTEGER)")
    con.executemany("INSERT INTO nations VALUES (?, ?, ?)", own)
    con.commit()
    body = con.serialize()
    con.close()
    types = dict(read(spark, d, "nation").dtypes)
    return formats.sqlite_table(_files(spark, {"nations.db": body}), "nations", f"id {types['n_nationkey']}, name string, region {types['n_regionkey']}")


@query("a8_inspected_source", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS row FROM region""")
def a8(spark, d):
    """A bounded look at a source; the table has fewer rows than the bound."""
    return reading.peek(read(spark, d, "region").select("r_regionkey", "r_name"), 20)


@query("a14_archive_filings", "SELECT 'CIK' || lpad(CAST(n_nationkey AS VARCHAR), 10, '0') || '.json' AS member, n_name || '-' || i AS accession, CASE WHEN i = 1 THEN '10-K' ELSE '10-Q' END AS form FROM nation, range(1, 4) r(i)")
def a14(spark, d):
    """Filings of the JSON members of an archive, their parallel arrays as rows."""
    import io
    import json
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in read(spark, d, "nation").collect():  # 25 rows
            recent = {"accession": [f"{r['n_name']}-{i}" for i in (1, 2, 3)], "form": ["10-K", "10-Q", "10-Q"]}
            z.writestr(f"CIK{r['n_nationkey']:010d}.json", json.dumps(recent))
    members = formats.zip_members(_files(spark, {"submissions.zip": out.getvalue()}))
    parsed = members.select("member", F.from_json(F.decode("content", "UTF-8"), "struct<accession:array<string>,form:array<string>>").alias("j")).select("member", "j.*")
    return formats.parallel_rows(parsed, ["accession", "form"], ["member"])


@query("b8_raw_objects", "SELECT r_name AS name, sha256(r_name) AS digest, TRUE AS verified FROM region")
def b8(spark, d):
    """Raw payloads stored once under their digest, read back and verified."""
    root = scratch(spark)
    names = [r["r_name"] for r in read(spark, d, "region").collect()]  # five rows
    digests = {n: [put_raw(spark, root, n.encode()) for _ in range(2)][0] for n in names}
    return spark.createDataFrame([(n, h, get_raw(spark, root, h) == n.encode()) for n, h in digests.items()], "name string, digest string, verified boolean")
