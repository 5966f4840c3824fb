import json

import pytest
from pyspark.sql import functions as F

from quernstone.plans.search import QUESTIONS
from quernstone.sources import index_io, listings, robots
from quernstone.streaming import windows
from tests.conftest import SF


def read(spark, source, body):
    rows = listings.READERS[source](spark.createDataFrame([("b", json.dumps(body))], "board_id string, body string"))
    return {r.external_id: r for r in rows.collect()}


def test_greenhouse(spark):
    job = {"id": 7, "title": " Buyer ", "absolute_url": "https://x.test/7", "location": {"name": "Arlo "}, "offices": [{"name": "HQ", "location": None}, {"name": "y", "location": "Bexley"}], "departments": [{"name": "Ops"}], "first_published": "2026-09-15T12:52:11-04:00", "content": "&lt;p&gt;Hi &amp;amp; you&lt;/p&gt;", "unknown": 1}
    got = read(spark, "greenhouse", {"jobs": [job, {**job, "title": "twice"}, {"id": 8, "title": " ", "absolute_url": "https://x.test/8"}]})
    r = got["7"]
    assert (r.kind, r.title, r.locations, [p.text for p in r.places], r.department, r.description_html, r.published_at) == ("posting", "Buyer", ["Arlo"], ["HQ", "Bexley"], "Ops", "<p>Hi &amp; you</p>", 1789491131000)
    assert got["8"].kind == "invalid"


def test_lever(spark):
    job = {"id": "a", "text": "Buyer", "hostedUrl": "https://x.test/a", "categories": {"allLocations": ["Arlo", "Dorn"], "commitment": "Full-time"}, "country": "de", "workplaceType": "On-Site", "createdAt": 5, "salaryRange": {"min": 1, "max": 2, "currency": "EUR", "interval": "per-hour-wage"}, "description": "<p>d</p>", "lists": [{"text": "A & B", "content": "<li>x</li>"}], "additional": "z"}
    r = read(spark, "lever", [job])["a"]
    assert (r.locations, r.country, r.workplace, r.published_at, r.salary.interval, r.description_html) == (["Arlo", "Dorn"], "DE", "onsite", 5, "hour", "<p>d</p><h3>A &amp; B</h3><ul><li>x</li></ul>z")


def test_ashby(spark):
    address = {"postalAddress": {"addressLocality": "Arlo", "addressRegion": None, "addressCountry": "Aland"}}
    job = {"id": "a", "title": "Buyer", "jobUrl": "https://x.test/a", "location": "HQ", "address": address, "secondaryLocations": [{"location": "Dorn"}], "isRemote": True, "compensation": {"summaryComponents": [{"compensationType": "Equity"}, {"compensationType": "Salary", "minValue": 5, "currencyCode": "EUR", "interval": "1 YEAR"}]}, "descriptionHtml": "d"}
    got = read(spark, "ashby", {"jobs": [job, {**job, "id": "b", "isListed": False}]})
    r = got["a"]
    assert (r.locations, [(p.label, p.text) for p in r.places], r.workplace, r.salary.min) == (["HQ", "Dorn"], [("HQ", "Arlo, Aland")], "remote", 5.0)
    assert got["b"].kind == "unlisted"


def test_a_listing_that_is_none_fails(spark):
    with pytest.raises(Exception, match="no listing"):
        read(spark, "greenhouse", [1])
    assert listings.url("lever-eu", "a b") == "https://api.eu.lever.co/v0/postings/a%20b?mode=json"


ROBOTS = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow: /*.pdf$\nCrawl-delay: 2\nDisallow: /same\nAllow: /same\n"


@pytest.mark.parametrize("agent,path,ok", [("a", "/x/1", False), ("b", "/x/y/1", True), ("a", "/f.pdf", True), ("c", "/f.pdf", False), ("c", "/f.pdfx", True), ("c", "/same", True), ("c", "/x", True), ("a", "/robots.txt", True)])
def test_robots(spark, agent, path, ok):
    rules = robots.rules_table(spark.createDataFrame([("h", ROBOTS)], "host string, body string"), "host", "body")
    assert robots.allowed(spark.createDataFrame([("h", path)], "host string, path string"), rules, agent).first().allowed is ok


def test_waiting():
    assert robots.delays(ROBOTS) == {"*": 2.0} and robots.retry_after_ms("3", 0) == 3000 and robots.retry_after_ms("x", 0) is None
    assert robots.retry_after_ms("Thu, 01 Jan 1970 00:00:10 GMT", 4000) == 6000 and robots.backoff_ms(3, 0.5) == 2000


def test_index_round_trip(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/index_rows.parquet").dropDuplicates(["id"])
    region = index_io.regions(F.col("places"), F.col("anywhere"), {"AA": "A", "ZZ": "Z"}, ["A", "Z", "anywhere"])
    parted = index_io.parts(rows, region, 10).cache()
    path = str(tmp_path / "index")
    name = index_io.write(parted, path, QUESTIONS)
    assert name == index_io.build_id(index_io.manifest(parted.repartition(3)), index_io.fingerprint(QUESTIONS)).first().build and len(name) == 12
    assert name != index_io.build_id(index_io.manifest(parted), index_io.fingerprint(QUESTIONS, {"arrangement": 2})).first().build
    back = index_io.read(spark, path)
    assert back.count() == rows.count() and index_io.check(spark, path, QUESTIONS) == []
    assert index_io.with_links(back, spark.read.parquet(f"{path}/links")).where("url IS NULL").count() == 0
    some = {r.region for r in index_io.read(spark, path, ["A"]).select("region").distinct().collect()}
    assert some <= {"A", "anywhere"}
    assert index_io.check(spark, path, {"arrangement": ("x",)}) == ["questions differ"]
    with pytest.raises(ValueError, match="holds"):
        index_io.read(spark, path, questions=QUESTIONS, versions={"arrangement": 2})
    spark.read.parquet(f"{path}/links").limit(1).write.mode("append").partitionBy("region", "part").parquet(f"{path}/links")
    assert any("other rows" in w for w in index_io.check(spark, path, QUESTIONS))


def test_stream_keeps_presence_runs(spark, tmp_path):
    schema = "board_id string, posting_id string, seq bigint, id bigint, extends_to bigint"
    for i, rows in enumerate([[("b", "x", 1, 10, 11), ("b", "y", 1, 10, 11)], [("b", "x", 3, 30, 30), ("b", "x", 3, 30, 30)], [("b", "y", 3, 30, 35)], [("b", "x", 2, 20, 25), ("b", "x", 1, 10, 11)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = windows.stream_of(spark, str(tmp_path / "in/*"), spark.createDataFrame([], schema).schema)
    out = windows.latest_runs(windows.drain(windows.presence_stream(stream), str(tmp_path / "drained")))
    assert {tuple(r) for r in out.collect()} == {("b", "x", 10, 30), ("b", "y", 10, 11), ("b", "y", 30, 35)}
