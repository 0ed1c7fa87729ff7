"""Sessions and manifests of a conversion as JSON and as page rows, and its settings."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("pending", "in_progress", "completed", "failed", "needs_llm")
PAGE_STATE = "struct<page:int,status:string,mode:string,reason:string,chars:bigint,tokens:bigint,processingTimeMs:bigint,retryCount:int,manifest:string,assets:string,error:string,escalated:boolean>"
SESSION = f"struct<sessionId:string,document:string,totalPages:int,model:string,dpi:int,createdAt:string,updatedAt:string,pages:array<{PAGE_STATE}>>"
MANIFEST = "struct<page:int,mode:string,reason:string,escalatedFrom:string,model:string,llmInput:string,codeFile:string,fallbackText:array<string>,assets:array<string>,assetsDir:string,injected:struct<fills:array<struct<fill:string,text:string>>,border:struct<color:string,width:double>,frame:struct<color:string,width:double>>>"
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """Fixed values are the defaults; command lines override them by name."""

    dpi: int = 200
    min_chars_for_text: int = 90
    column_gap_pts: float = 40.0
    llm_mode: str = "auto"
    model: str = "sonnet"
    escalation_model: str = "opus"
    concurrency: int = 4
    retries: int = 1
    verify_retries: int = 1
    coverage_min: float = 0.6
    heading_ratio: float = 1.15
    compact_json: bool = True
    gate: bool = True
    fix_rounds: int = 2

    def overridden(self, flags: list[str]) -> Settings:
        """By flags such as --dpi 150, --llm-mode none, --no-gate; unknown names are an error."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        out, at = {}, 0
        while at < len(flags):
            name = flags[at].lstrip("-").replace("-", "_")
            if name.startswith("no_") and kinds.get(name[3:]) is bool:
                out[name[3:]] = False
            elif kinds.get(name) is bool:
                out[name] = True
            elif name in kinds and at + 1 < len(flags):
                at += 1
                out[name] = kinds[name](flags[at])
            else:
                raise ValueError(f"unknown setting {flags[at]}")
            at += 1
        return replace(self, **out)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, json.dumps(v)) for k, v in asdict(self).items()], "name string, value string")


def roles(text: str, spark: SparkSession) -> DataFrame:
    """(role, rank, provider, model) from JSON {role: [{provider, model}, ..]}: candidates in order."""
    rows = [(role, i, c.get("provider"), c.get("model")) for role, found in json.loads(text).items() for i, c in enumerate(found)]
    return spark.createDataFrame(rows, "role string, rank int, provider string, model string")


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def started(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(document, total_pages) to one JSON session each: every page pending, an ID of name and time, ISO times."""
    now = F.current_timestamp()
    page = F.transform(F.sequence(F.lit(1), F.col("total_pages")), lambda i: F.struct(i.alias("page"), F.lit("pending").alias("status"), F.lit(0).alias("retryCount"), F.format_string("pages/page_%04d.json", i).alias("manifest"), F.format_string("assets/page_%04d", i).alias("assets")))
    iso = F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    named = F.concat_ws("-", F.regexp_replace("document", r"\.[^.]*$", ""), base36(F.unix_millis(now)))
    record = F.struct(named.alias("sessionId"), "document", F.col("total_pages").alias("totalPages"), F.lit(settings.model).alias("model"), F.lit(settings.dpi).alias("dpi"), iso.alias("createdAt"), iso.alias("updatedAt"), page.alias("pages"))
    return documents.select("document", F.to_json(record).alias("json"))


def page_rows(sessions: DataFrame, json: str = "json") -> DataFrame:
    """A row a page, with document and session; a session that is no JSON has none."""
    read = sessions.select(F.from_json(json, SESSION).alias("s"))
    return read.select("s.document", "s.sessionId", "s.totalPages", F.explode("s.pages").alias("p")).select("document", "sessionId", "totalPages", "p.*")


def session_json(page_states: DataFrame, key: str) -> DataFrame:
    """key, json: sessions from page rows (page, status, and any other fields of a page), pages in order."""
    own = [c for c in page_states.columns if c != key]
    rows = page_states.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", *[c for c in own if c != "page"]))).alias("pages"))
    return rows.select(key, F.to_json(F.struct(F.col(key).cast("string").alias("document"), F.size("pages").alias("totalPages"), "pages")).alias("json"))


class Conflict(Exception):
    """Another writer has committed the version that was to be written."""


def claimed(spark: SparkSession, target: str, content: str) -> bool:
    """Makes a file with this content unless there is one of its name; False if there is. Of several writers one succeeds, and readers see all of it or nothing.

    The content goes to a file of another name first, which is then linked (local and mounted folders) or renamed (file systems whose rename keeps what
    exists, as HDFS) to the target.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside = hadoop.Path(f"{target}.{uuid.uuid4().hex}")
    system = aside.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = system.create(aside)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if system.getUri().getScheme() != "file":
            return system.rename(aside, hadoop.Path(target))
        os.link(aside.toUri().getPath(), hadoop.Path(target).toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        system.delete(aside, False)


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The committed versions, from 1, and the file of each."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(folder):
        return {}
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    return {int(n[:-5]): f"{path}/log/{n}" for n in names if re.fullmatch(r"\d{20}\.json", n)}


def save(page_states: DataFrame, path: str, version: int | None = None) -> int:
    """Commits the whole state as the version given (the next one if none is), which it returns: a table under a new name, then an entry of the log that names it.

    Conflict if that version exists by then; the state that was there stays. A writer that dies before the entry leaves a table that nobody reads.
    """
    spark = page_states.sparkSession
    version = version or max(versions(spark, path), default=0) + 1
    if version > 1 and version - 1 not in versions(spark, path):
        raise ValueError(f"there is no version {version - 1} of {path}")
    name = f"state-{uuid.uuid4().hex}"
    page_states.write.parquet(f"{path}/{name}")
    if not claimed(spark, f"{path}/log/{version:020d}.json", json.dumps({"version": version, "state": name})):
        raise Conflict(f"version {version} of {path} exists")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The state of a version, the latest if none is given."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no session is saved in {path}")
    entry = json.loads(spark.read.text(known[version or max(known)], wholetext=True).first()[0])
    return spark.read.parquet(f"{path}/{entry['state']}")


def changed(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
    """Commits change(latest state) and returns its version; begins again from the newer state where another writer was first, so no change is lost."""
    for _ in range(tries):
        at = max(versions(spark, path), default=0)
        try:
            return save(change(load(spark, path, at)), path, at + 1)
        except Conflict:
            continue
    raise Conflict(f"{path} changed {tries} times meanwhile")


def manifests(of_files: DataFrame, json: str = "json") -> DataFrame:
    """The fields of manifests; what is no JSON is left out."""
    return of_files.select(F.from_json(json, MANIFEST).alias("m")).filter("m is not null").select("m.*")
