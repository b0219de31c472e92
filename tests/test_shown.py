import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import platform, views
from sightline.sources import artefacts, reports


def test_evidence_of_any_shape(spark):
    rows = [(1, '{"source": "naver_serp", "competitorName": "", "name": "x", "serpRank": 2.0, "found": false}'), (2, "[]"), (3, '[{"reason": "not_measured"}, [1.5, {"a": 1}]]'), (4, None), (5, "no json"), (6, "NaN")]
    got = views.evidence_items(spark.createDataFrame(rows, "id long, evidence string")).orderBy("id", "place").collect()
    of = lambda i: [(r["label"], r["detail"]) for r in got if r["id"] == i]
    assert of(1) == [("출처", "네이버 검색"), ("순위", "2"), ("확인 결과", views.NOT_FOUND)]
    assert of(2) == [("확인 상태", views.NO_EVIDENCE)] and of(3) == [("확인 상태", "아직 확인하지 못했어요."), ("확인 근거 2 1", "1.5"), ("확인 근거 2 2", views.SUMMARISED)]
    assert of(4) == [("확인 근거", views.UNKNOWN)] and of(5) == [("확인 근거", "no json")] and of(6) == [("확인 근거", "NaN")]


def test_copy_rules_hide_texts(spark):
    rows = [("s", 1, "LOCAL_BUSINESS", "좋은 카페예요"), ("s", 2, "LOCAL_BUSINESS", "매출이 늘어요"), ("s", 3, "ORGANIZATION", "SEO를 해요"), ("s", 4, "SERVICE", "메일"), ("s", 5, "OTHER", "글"), ("s", 6, "ORGANIZATION", " \n"), ("s", 7, "ORGANIZATION", None), ("s", 8, "FAQ_HTML", "GEO-PHONE-001"), ("s", 9, None, "글")]
    df = spark.createDataFrame(rows, "business_id string, pos int, type string, code string")
    assert [r["pos"] for r in views.asset_view(df, paid=True).collect()] == [1, 4] and [r["pos"] for r in views.asset_view(df, paid=False).collect()] == [1]


def test_claims_end_with_the_queue(spark):
    jobs = spark.createDataFrame([(k, "queued" if k < 8 else "running", 0, 10 - k) for k in range(10)], "id int, status string, attempts int, created_at int")
    first = views.claim(jobs, 5)
    assert sorted(r["id"] for r in first.where("claimed").collect()) == [3, 4, 5, 6, 7]
    second = views.claim(first.drop("claimed"), 5)
    assert sorted(r["id"] for r in second.where("claimed").collect()) == [0, 1, 2] and second.where("attempts > 1 OR status <> 'running'").count() == 0


def test_presence_of_a_platform_page(spark):
    text = "메뉴 coffee 예약 가능 서울 강남구 테헤란로 12길 3층\n영업시간 매일 09:00 - 21:00\n전화 02-555-1234 후기"
    rows = [("a", "naver_place", "https://map.naver.com/p/entry/place/1", "가나 카페 - 네이버 플레이스", None, None, {}, text), ("b", "instagram", "https://i.example/x", None, None, None, {"og:title": "다라"}, "x" * 90), ("c", "zzz", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "site_id string, source_type string, url string, h1 string, title string, description string, meta map<string,string>, body_text string")
    a, b, c = platform.platform_presence(df).orderBy("site_id").collect()
    assert (a["name"], a["phone"], a["address"], a["region"], a["confidence"]) == ("가나 카페", "02-555-1234", "서울 강남구 테헤란로 12길 3층", "서울", "low") and a["opening_hours"].startswith("영업시간 매일 09:00")
    assert a["services"][:3] == ["coffee", "메뉴", "예약"] and a["booking_hint"] and a["review_hint"] and not a["photo_hint"] and a["surface_kind"] == "place"
    assert (b["name"], b["confidence"], b["phone"]) == ("다라", "medium", None) and (c["name"], c["description"], c["services"], c["confidence"]) == (None, None, [], "low")


def test_relevance(spark):
    df = spark.createDataFrame([(["커피", "Latte", "x"], ["커피 원두", "latte art", ""]), ([], ["a"]), (["a"], []), (None, None)], "t array<string>, r array<string>")
    assert [r[0] for r in df.select(views.relevance(F.col("t"), F.col("r"))).collect()] == [2 / 3, 0.0, 0.5, 0.5]


def test_stored_artefacts(spark, tmp_path):
    row = lambda *rows: spark.createDataFrame(rows, "diagnosis_id int, pos int, action_ref string")
    t = artefacts.linked(row((1, 2, None), (1, 1, None)).drop("action_ref"), row((1, 5, None), (2, 1, None)).drop("action_ref"), row((1, 1, "x"), (1, 2, "y"), (2, 1, "z")))
    artefacts.save(t, str(tmp_path), "diagnosis_id")
    artefacts.save({"actions": t["actions"].where("diagnosis_id = 2")}, str(tmp_path), "diagnosis_id")
    got = artefacts.load(spark, str(tmp_path), "rivals", "gap_rows", "actions", "none such")
    gaps = got["gap_rows"].collect()
    assert set(got) == {"rivals", "gap_rows", "actions"} and [g["rival_id"] for g in gaps] == [got["rivals"].where("pos = 1").first()["id"]]
    assert [r["action_ref"] for r in got["actions"].orderBy("diagnosis_id", "pos").collect()] == [gaps[0]["id"], "y", "z"]
    assert artefacts.linked(row().drop("action_ref"), row().drop("action_ref"), row())["actions"].count() == 0


def test_a_write_that_fails_shows_nothing(spark, tmp_path):
    """Readers see three tables of one version, whatever becomes of the next."""
    folder = str(tmp_path / "store")
    table = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    assert artefacts.load(spark, folder, "a", "b") == {}
    artefacts.save({"a": table((1, "old"), (2, "old")), "b": table((1, "old")), "c": table((None, "old"))}, folder, "k")
    broken = table((1, "new")).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        artefacts.save({"a": table((1, "new"), (3, "new")), "b": broken, "c": table()}, folder, "k")
    read = lambda: {n: sorted(map(tuple, df.collect()), key=repr) for n, df in artefacts.load(spark, folder, "a", "b", "c").items()}
    assert read() == {"a": [(1, "old"), (2, "old")], "b": [(1, "old")], "c": [(None, "old")]}
    before = artefacts.load(spark, folder, "a")["a"]
    artefacts.save({"a": table((1, "new"), (1, "newer"), (3, "new")), "c": table((None, "new"))}, folder, "k")
    assert read() == {"a": [(1, "new"), (1, "newer"), (2, "old"), (3, "new")], "b": [(1, "old")], "c": [(None, "new")]}
    # who opened the store before still reads what it had then
    assert sorted(map(tuple, before.collect())) == [(1, "old"), (2, "old")]
    # the next number is taken by another writer
    (tmp_path / "store" / "_commits" / "000000000002").write_text("other")
    (tmp_path / "store" / "_commits" / ".000000000002.crc").unlink(missing_ok=True)
    artefacts.save({"b": table((9, "last"))}, folder, "k")
    assert read()["b"] == [(1, "old"), (9, "last")]


def test_reports_are_a_file_a_site(spark, tmp_path):
    folder = str(tmp_path / "reports")
    scores = spark.createDataFrame([("a/b c", 90, 80, 70, None, 82), ("z", 10, 0, 0, 5, 6), ("%41+", 50, 50, 50, None, 50)], "site_id string, seo int, aeo int, geo int, perf int, overall int")
    item = lambda site, pos, rule, level, action: (site, pos, pos * 2, f"{site}-{rule}", rule, "SEO", level, 10, action, "easy")
    items = spark.createDataFrame([item("z", i, f"R{i}", ["low", "high", "medium"][i % 3], ["self_fix", "si_action"][i % 2]) for i in range(1, 8)], "site_id string, position int, rule_pos int, item_id string, rule_id string, category string, priority string, impact_score int, action_type string, difficulty string")
    made = reports.site_reports(scores, items)
    reports.write_reports(made.repartition(4), folder)
    read = lambda: {r["site_id"]: r["report"] for r in reports.read_reports(spark, folder).collect()}
    want = {r["site_id"]: r["report"] for r in made.collect()}
    assert read() == want and len(list((tmp_path / "reports").rglob("*.json"))) == 4
    z, a = json.loads(want["z"]), json.loads(want["a/b c"])
    assert [i["rule_id"] for i in z["summary"]["top_issues"]] == ["R1", "R4", "R7", "R2", "R5"] and [i["position"] for i in z["items"]] == list(range(1, 8))
    assert z["summary"]["action_counts"] == {"self_fix": 3, "snippet_action": 0, "vendor_action": 0, "si_action": 4} and z["scores"]["grade"] == "poor"
    assert a["scores"]["perf"] is None and a["scores"]["grade"] == "excellent" and a["items"] == [] and a["summary"]["headline"] == reports.HEADLINES[0][1]
    # a job that fails leaves what was there, and nothing of its own
    broken = made.withColumn("report", F.when(F.col("site_id") == "z", F.raise_error(F.lit("no")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="no"):
        reports.write_reports(broken.repartition(3), folder)
    assert read() == want and not list((tmp_path / "reports").glob("_staging*"))
    reports.write_reports(spark.createDataFrame([("new", "{}")], "site_id string, report string"), folder, mode="append")
    assert read() == want | {"new": "{}"}
    reports.write_reports(made.limit(0), folder)
    assert not list((tmp_path / "reports").rglob("z.json"))
