"""Reports of sites: the documents, and a sink that writes a file a site.

The sink is a Python data source.  Tasks write below a staging folder of their
job; the driver moves a task's folder as a whole when all tasks are done and then
names the job as the current one, so readers see a finished set or the one
before.  A task that runs again writes to a folder of its own."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators import scoring

VERSION = "1.0.0"
#: What a report says of an overall score, best first, and of itself.
HEADLINES = [
    (80, "홈페이지의 SEO/AEO/GEO 최적화 수준이 전반적으로 우수합니다. 일부 세부 항목을 보완하면 더욱 완성도 있는 구조를 갖출 수 있습니다."),
    (60, "홈페이지의 기본 구조는 갖춰져 있으나 FAQ, 구조화 데이터, 지역 기반 서비스 설명이 부족합니다. 우선순위 높은 항목부터 개선하세요."),
    (40, "홈페이지의 SEO 최적화가 미흡합니다. 기본 메타 태그, 구조화 데이터, 지역 정보 등 핵심 항목을 우선 개선해야 합니다."),
    (None, "홈페이지의 검색엔진·AI 검색 최적화가 매우 부족한 상태입니다. 기초부터 체계적인 개선이 필요합니다."),
]
DISCLAIMER = "참고 지표입니다. 노출을 보장하지 않습니다."
TOP = 5


def headline(overall: Column) -> Column:
    out = None
    for least, said in HEADLINES[:-1]:
        out = F.when(overall >= least, said) if out is None else out.when(overall >= least, said)
    return out.otherwise(HEADLINES[-1][1])


def site_reports(scores: DataFrame, items: DataFrame, version: str = VERSION) -> DataFrame:
    """scores: site_id, seo, aeo, geo, perf, overall.  items: diagnosis items with
    their position.  A row a site of scores: site_id and ``report``, JSON.

    A report has the scores with their grade, a headline, the TOP items by
    priority (equals in the order of rules), how many items each action has, and
    all items in their order; null fields are written.  A site without items has
    empty lists.  Items are summed up once a site, so a site's items must fit in
    memory: there are no more than rules."""
    level = scoring.lookup({"high": 0, "medium": 1, "low": 2}, F.col("priority"), 3)
    item = F.struct("position", level.alias("level"), "rule_pos", "item_id", "rule_id", "category", "priority", "impact_score", "action_type", "difficulty")
    per_site = items.groupBy("site_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    x = scores.join(per_site, "site_id", "left").withColumn("_items", F.coalesce("_items", F.array().cast(per_site.schema["_items"].dataType)))
    of = lambda action: lambda i: i["action_type"] == action
    some = lambda i, *names: F.struct(*(i[n].alias(n) for n in names))
    by_level = F.array_sort(F.transform("_items", lambda i: F.struct(i["level"].alias("level"), i["rule_pos"].alias("rule_pos"), i["item_id"].alias("item_id"), i["rule_id"].alias("rule_id"), i["category"].alias("category"), i["priority"].alias("priority"))))
    document = F.struct(
        F.lit(version).alias("version"), F.col("site_id").cast("string").alias("site_id"),
        F.struct("overall", "seo", "aeo", "geo", "perf", scoring.grade(F.col("overall")).alias("grade"), F.lit(DISCLAIMER).alias("disclaimer")).alias("scores"),
        F.struct(
            headline(F.col("overall")).alias("headline"), F.transform(F.slice(by_level, 1, TOP), lambda i: some(i, "item_id", "rule_id", "category", "priority")).alias("top_issues"),
            F.struct(*(F.size(F.filter("_items", of(a))).alias(a) for a in scoring.ACTIONS)).alias("action_counts"),
        ).alias("summary"),
        F.transform("_items", lambda i: some(i, "position", "item_id", "rule_id", "category", "priority", "impact_score", "action_type", "difficulty")).alias("items"),
    )
    return x.select("site_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("report"))


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator[Row]) -> _Written:
        """A file for each row: the first column names it, the second is what it holds."""
        where, root = self._fs()
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}"
        folder = f"{root}/_staging-{self.job}/{context.taskAttemptId()}-{name}"
        where.create_dir(folder)
        n = 0
        for site, text in rows:
            with where.open_output_stream(f"{folder}/{quote(str(site), safe='')}.json") as out:
                out.write((text or "null").encode())
            n += 1
        return _Written(folder, n)

    def _current(self) -> list[str]:
        where, root = self._fs()
        try:
            with where.open_input_stream(f"{root}/current.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return []

    def commit(self, messages: list[_Written | None]) -> None:
        where, root = self._fs()
        before = self._current()
        where.create_dir(f"{root}/reports-{self.job}")
        for m in messages:
            if m is not None and m.files:
                where.move(m.folder, f"{root}/reports-{self.job}/{m.folder.rsplit('-', 1)[1]}")
        now = [*([] if self.overwrite else before), f"reports-{self.job}"]
        with where.open_output_stream(f"{root}/_current-{self.job}.json") as f:
            f.write(json.dumps(now).encode())
        where.move(f"{root}/_current-{self.job}.json", f"{root}/current.json")
        for old in [f"_staging-{self.job}", *(before if self.overwrite else [])]:
            where.delete_dir(f"{root}/{old}")

    def abort(self, messages: list[_Written | None]) -> None:
        where, root = self._fs()
        if where.get_file_info(f"{root}/_staging-{self.job}").type.name == "Directory":
            where.delete_dir(f"{root}/_staging-{self.job}")


class ReportSink(DataSource):
    """``df.write.format("site_reports").mode(...).save(folder)`` for rows of a
    site and its text.  The folder is one that all executors share.  Rows that
    repeat a site within a task end in one file, the last.  Append adds to what is
    there, overwrite replaces it."""

    @classmethod
    def name(cls) -> str:
        return "site_reports"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if len(schema.fields) != 2:
            raise ValueError("site_reports takes two columns: a site and its text")
        return _Writer(self.options["path"], overwrite)


def write_reports(reports: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """site_id, report to a file a site below folder."""
    reports.sparkSession.dataSource.register(ReportSink)
    reports.select("site_id", "report").write.format("site_reports").mode(mode).save(folder)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """site_id (text) and report of the files that are current."""
    current = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/current.json").collect()))
    files = spark.read.option("recursiveFileLookup", "true").text([f"{folder}/{c}" for c in current], wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    # the reader shows a name's own escapes escaped once more
    return files.select(F.url_decode(F.replace(F.replace(name, F.lit("%25"), F.lit("%")), F.lit("+"), F.lit("%2B"))).alias("site_id"), F.col("value").alias("report"))
