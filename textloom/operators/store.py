"""The content store: versions of Parquet tables with a pointer to the current ones, and changes as functions of frames.

A change never touches stored files: it writes new versions of the tables it alters, and then a pointer with the next number;
the highest one is current. A run that dies in between leaves the old state, and of two that take the same number one fails.
The functions of frames are the operators; the store itself is kept small on purpose: a change rewrites the tables it alters,
so at scale one batch of many rows should be a change, not one row.
"""

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.urls import url_hash
from textloom.operators.analysis import Settings, best_relevance, judge, term_counts, text_metrics
from textloom.operators.clean import cleaned
from textloom.operators.keywords import of_pairs
from textloom.operators.known_keys import KnownKeys
from textloom.schema import CONTENT_CHILDREN, assert_unique, schema_of
from textloom.session import stored as written

POINTERS = "current"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{POINTERS}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> int:
        """The number of the last pointer; 0 if there is none."""
        path, fs = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(x[: -len(".json")]) for x in names if re.fullmatch(r"\d+\.json", x)), default=0)

    def versions(self) -> dict[str, str]:
        """The current version of each table that was ever written."""
        last = self._last()
        return json.loads(self.spark.read.text(f"{self.root}/{POINTERS}/{last}.json").first()[0]) if last else {}

    def read(self, table: str) -> DataFrame:
        version = self.versions().get(table)
        schema = schema_of(table)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{version}") if version else self.spark.createDataFrame([], schema)

    def commit(self, **tables: DataFrame) -> None:
        """Write new versions of the tables, check their keys, then make all current at once."""
        number, versions = self._last() + 1, self.versions()
        for name, df in tables.items():
            version = uuid.uuid4().hex
            own = df.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(name)])
            writer = own.write.partitionBy("workspace_id") if "workspace_id" in own.columns else own.write
            writer.parquet(f"{self.root}/{name}/{version}")
            versions[name] = version
            assert_unique(self.spark.read.schema(schema_of(name)).parquet(f"{self.root}/{name}/{version}"), name)
        path, fs = self._fs()
        new, place = path.suffix("-" + uuid.uuid4().hex), self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{number}.json")
        out = fs.create(new)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        fs.mkdirs(path)
        # The old pointer stays until the new one is there under the next number, which nobody else may have taken.
        if fs.exists(place) or not fs.rename(new, place):
            raise RuntimeError(f"another change was committed as number {number}")


def with_ids(rows: DataFrame, kept: DataFrame, order: list[str]) -> DataFrame:
    """Ids that go on from the stored ones, gapless and in order, for any number of rows.

    Rows are sorted by ranges and stored with their range and their place in it; the counts of the ranges, a row for each, say
    where a range begins. So no task holds all rows.
    """
    last = kept.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    spread = rows.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(spread, "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_start")).withColumn("_k", F.lit(1)).join(F.broadcast(last.withColumn("_k", F.lit(1))), "_k").drop("_k")
    found = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return found.withColumn("id", F.col("last") + F.col("_start") + place + 1).drop("_at", "_part", "_start", "last")


def unknown_rows(batch: DataFrame, contents: DataFrame | KnownKeys) -> DataFrame:
    """The batch's rows that are not stored, the first of each URL, with url_hash."""
    keyed = batch.withColumn("url_hash", url_hash(F.col("url")))
    first = Window.partitionBy("workspace_id", "url_hash").orderBy("ordinal")
    once = keyed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
    return contents.without(once) if isinstance(contents, KnownKeys) else once.join(contents.select("workspace_id", "url_hash"), ["workspace_id", "url_hash"], "left_anti")


def new_contents(batch: DataFrame, contents: DataFrame | KnownKeys) -> DataFrame:
    """The batch's rows that are not stored, the first of each URL, as rows of contents. batch: workspace_id, ordinal and columns of contents.

    With known keys in the place of contents, stored keys are not shuffled."""
    fresh, kept = unknown_rows(batch, contents), contents.read() if isinstance(contents, KnownKeys) else contents
    return with_ids(fresh.withColumns({"publisher": F.substring("publisher", 1, 200), "body_length": F.length("cleaned_body")}), kept, ["ordinal"])


def placed_hits(candidates: DataFrame, contents: DataFrame | KnownKeys) -> DataFrame:
    """The first candidate of each stored content and keyword, with content_id."""
    keyed = candidates.withColumn("url_hash", url_hash(F.col("url")))
    # Before the join, as a URL has one content: so no task gets all candidates of a frequent one.
    first = Window.partitionBy("workspace_id", "url_hash", "keyword").orderBy("priority", "ordinal")
    once = keyed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
    if isinstance(contents, KnownKeys):
        return contents.found(once)
    return once.join(contents.select("workspace_id", "url_hash", F.col("id").alias("content_id")), ["workspace_id", "url_hash"])


def new_hits(candidates: DataFrame, contents: DataFrame | KnownKeys, keywords: DataFrame, hits: DataFrame) -> DataFrame:
    """The first hit of each content and keyword. candidates: workspace_id, keyword, url, rank, job_id, found_at, priority, ordinal
    (articles come before raw items). A keyword that is no longer registered keeps its text."""
    registered = keywords.groupBy("workspace_id", "keyword").agg(F.min("id").alias("source_keyword_id"))
    once = placed_hits(candidates, contents).join(registered, ["workspace_id", "keyword"], "left")
    return with_ids(once.join(hits.select("content_id", "keyword"), ["content_id", "keyword"], "left_anti"), hits, ["priority", "ordinal"])


def save(store: Store, batch: DataFrame, candidates: DataFrame, job: DataFrame, responses: DataFrame | None = None) -> dict[str, int]:
    """One collection: raw responses, new contents and hits, the job's end, the source's watermark, all or nothing. Saving the same again adds nothing.

    job: a row of collection_jobs with its final state. responses: workspace_id, job_id, keyword, response, created_at; those of a job
    and keyword that are stored already stay as they are.
    """
    contents, hits, jobs, sources = (store.read(x) for x in ("contents", "content_keyword_hits", "collection_jobs", "sources"))
    fresh = new_contents(batch, contents).persist()
    all_contents = contents.unionByName(fresh.select(*contents.columns))
    found = new_hits(candidates, all_contents, store.read("source_keywords"), hits).persist()
    latest = batch.groupBy("source_id").agg(F.max("published_at").alias("_latest")).withColumnRenamed("source_id", "id")
    moved = sources.join(latest, "id", "left").withColumn("last_published_at", F.greatest("last_published_at", "_latest")).drop("_latest")
    summary = {"new": fresh.count(), "known": batch.count() - fresh.count(), "new_hits": found.count()}
    more = {}
    if responses is not None:
        raw = store.read("job_api_responses")
        late = with_ids(responses.join(raw.select("job_id", "keyword"), ["job_id", "keyword"], "left_anti"), raw, ["job_id", "keyword"])
        more["job_api_responses"] = raw.unionByName(late.select(*raw.columns))
    store.commit(**more, contents=all_contents, content_keyword_hits=hits.unionByName(found.select(*hits.columns)), collection_jobs=replaced(jobs, job.select(*jobs.columns), ["id"]), sources=moved.select(*sources.columns))
    fresh.unpersist()
    found.unpersist()
    return summary


def replaced(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows take the place of stored rows with their keys."""
    return stored.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def pending(contents: DataFrame, analyses: DataFrame) -> DataFrame:
    return contents.join(analyses.select(F.col("content_id").alias("id")), "id", "left_anti")


def hits_without_stats(hits: DataFrame, analyses: DataFrame, stats: DataFrame) -> DataFrame:
    """Hits of analysed contents whose keyword has no statistics yet."""
    return hits.join(analyses.select("content_id"), "content_id", "left_semi").join(stats.select("content_id", "keyword"), ["content_id", "keyword"], "left_anti")


def stats_for(hits: DataFrame, contents: DataFrame, settings: Settings) -> DataFrame:
    texts = contents.select(F.col("id").alias("content_id"), "title", "cleaned_body")
    found = of_pairs(hits.select("workspace_id", "content_id", "keyword"), texts, "content_id", F.col("title"), F.col("cleaned_body"))
    return found.withColumn("relevance", judge(F.col("mentions"), F.col("density"), F.col("title_has"), F.col("length"), settings)).drop("length")


def analyze_pending(store: Store, settings: Settings = Settings(), analyzer: str = "runs") -> dict[str, int]:
    """Contents without analysis get one; analysed contents with new keywords get those statistics only. A second run adds nothing."""
    contents, hits, analyses, terms, stats = (store.read(x) for x in ("contents", "content_keyword_hits", "content_analyses", "content_terms", "content_keyword_stats"))
    todo = pending(contents, analyses).persist()
    text = F.when(F.lit(settings.min_body or 0) <= F.length("cleaned_body"), F.col("cleaned_body")).otherwise(F.lit(""))
    read = todo.withColumn("_text", text)
    metrics = text_metrics(read, "_text").select("workspace_id", F.col("id").alias("content_id"), F.lit(settings.version).alias("settings_version"), F.lit(analyzer).alias("analyzer"), "body_length", "tokens", "unique_tokens", "nouns", "sentences", "avg_sentence_len", "ttr", F.current_timestamp().alias("analyzed_at"))
    words = term_counts(read, "id", "_text").withColumnRenamed("id", "content_id").join(todo.select(F.col("id").alias("content_id"), "workspace_id"), "content_id")
    late = hits_without_stats(hits, analyses, stats).persist()
    fresh_hits = hits.join(todo.select(F.col("id").alias("content_id")), "content_id", "left_semi").unionByName(late)
    judged = stats_for(fresh_hits, contents, settings)
    all_stats = stats.unionByName(with_ids(judged, stats, ["content_id", "keyword"]).select(*stats.columns))
    all_analyses = analyses.drop("relevance").unionByName(with_ids(metrics, analyses, ["content_id"]).drop("relevance"))
    refreshed = all_analyses.join(best_relevance(all_stats, "content_id"), "content_id", "left").select(*analyses.columns)
    summary = {"analyzed": todo.count(), "stats_only": late.select("content_id").distinct().count()}
    store.commit(content_analyses=refreshed, content_terms=terms.unionByName(with_ids(words, terms, ["content_id", "term", "pos"]).select(*terms.columns)), content_keyword_stats=all_stats)
    todo.unpersist()
    late.unpersist()
    return summary


def recleaned(contents: DataFrame, limits: DataFrame) -> DataFrame:
    """id, before, after, changed, short: what cleaning the raw bodies again gives. limits: source_id, min_body_length."""
    again = cleaned(contents, "raw_body", "again", title_col="title").join(limits, "source_id", "left")
    return again.select("id", F.length("cleaned_body").alias("before"), F.length("again").alias("after"), (F.col("cleaned_body") != F.col("again")).alias("changed"), (F.length("again") < F.coalesce("min_body_length", F.lit(0))).alias("short"), "again")


def reclean(store: Store, dry_run: bool = False, settings: Settings = Settings()) -> dict[str, int]:
    """Clean all raw bodies again; changed contents lose their analysis and get a new one. Short ones are told, not deleted."""
    contents = store.read("contents")
    found = recleaned(contents, store.read("sources").select(F.col("id").alias("source_id"), "min_body_length")).persist()
    row = found.agg(F.count("*"), F.count_if("changed"), F.count_if(F.col("changed") & F.col("short"))).first()
    summary = {"checked": row[0], "changed": row[1], "short": row[2]}
    if not dry_run and summary["changed"]:
        changed = found.where("changed").select("id", "again")
        new = contents.join(changed, "id", "left").withColumn("cleaned_body", F.coalesce("again", "cleaned_body")).withColumn("body_length", F.length("cleaned_body")).drop("again")
        gone = changed.select(F.col("id").alias("content_id"))
        children = {x: store.read(x).join(gone, "content_id", "left_anti") for x in ("content_analyses", "content_terms", "content_keyword_stats")}
        store.commit(contents=new, **children)
        analyze_pending(store, settings)
    found.unpersist()
    return summary


def without(children: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows that do not hang on the contents that go. gone: id."""
    return children.join(gone.select(F.col("id").alias("content_id")), "content_id", "left_anti")


def delete_contents(store: Store, workspace_id: str, ids: list[int]) -> None:
    """Contents of the tenant go with all that hangs on them."""
    contents = store.read("contents")
    gone = contents.where((F.col("workspace_id") == workspace_id) & F.col("id").isin(ids)).select("id")
    children = {x: without(store.read(x), gone) for x in CONTENT_CHILDREN}
    store.commit(contents=contents.join(gone, "id", "left_anti"), **children)


def remove_keywords(store: Store, ids: list[int]) -> None:
    """Keywords go; their hits keep the text and lose the reference."""
    hits = store.read("content_keyword_hits")
    gone = F.col("source_keyword_id").isin(ids)
    store.commit(source_keywords=store.read("source_keywords").where(~F.col("id").isin(ids)), content_keyword_hits=hits.withColumn("source_keyword_id", F.when(gone, None).otherwise(F.col("source_keyword_id"))))


def add_keywords(store: Store, workspace_id: str, source_id: int, words: list[str], origin: str = "user") -> int:
    """Words that the source does not have yet, normalised, each once, in order; blank ones are left out."""
    clean = list(dict.fromkeys(w for w in (" ".join(x.split()) for x in words) if w))
    stored = store.read("source_keywords")
    rows = store.spark.createDataFrame([(i, workspace_id, source_id, w, origin) for i, w in enumerate(clean)], "ordinal int, workspace_id string, source_id long, keyword string, origin string")
    fresh = with_ids(rows.join(stored.select("source_id", "keyword"), ["source_id", "keyword"], "left_anti"), stored, ["ordinal"]).withColumn("created_at", F.current_timestamp())
    n = fresh.count()
    if n:
        store.commit(source_keywords=stored.unionByName(fresh.select(*stored.columns)))
    return n


def queue_jobs(store: Store, workspace_id: str, source_ids: list[int] | None = None, trigger: str = "manual") -> list[int]:
    """Queued jobs for the sources (all active ones by default), each once; busy ones are skipped; one unknown id and nothing is queued."""
    sources, jobs = store.read("sources").where(F.col("workspace_id") == workspace_id), store.read("collection_jobs")
    known = {r["id"]: r["is_active"] for r in sources.select("id", "is_active").collect()}
    wanted = list(dict.fromkeys(source_ids)) if source_ids is not None else sorted(i for i, active in known.items() if active)
    if missing := [i for i in wanted if i not in known]:
        raise KeyError(f"unknown sources: {missing}")
    busy = {r[0] for r in jobs.where(F.col("status").isin("queued", "running")).select("source_id").distinct().collect()}
    todo = [i for i in wanted if i not in busy]
    if todo:
        rows = store.spark.createDataFrame([(n, workspace_id, i, trigger, "queued", 0) for n, i in enumerate(todo)], "ordinal int, workspace_id string, source_id long, trigger string, status string, collected_count int")
        new = with_ids(rows, jobs, ["ordinal"]).withColumn("queued_at", F.current_timestamp())
        store.commit(collection_jobs=jobs.unionByName(new.drop("ordinal"), allowMissingColumns=True))
    return todo


#: Which state may follow which.
TRANSITIONS = {"queued": ("running", "failed"), "running": ("success", "failed"), "success": (), "failed": ()}


def partial_error(failed: list[str], skipped: int = 0) -> str | None:
    """What a successful job tells of keywords that failed and rows that were skipped; None if all went well."""
    parts = [f"failed: {', '.join(failed)}"] * bool(failed) + [f"skipped: {skipped}"] * bool(skipped)
    return "; ".join(parts) or None


def advance_job(store: Store, job_id: int, status: str, error: str | None = None) -> None:
    """The job's next state. A state that may not follow is refused, so an ended job is not run again."""
    jobs = store.read("collection_jobs")
    row = jobs.where(F.col("id") == job_id).select("status").first()
    if row is None or status not in TRANSITIONS[row[0]]:
        raise ValueError(f"job {job_id} can't become {status}")
    own, now = F.col("id") == job_id, F.current_timestamp()
    ended = status in ("success", "failed")
    out = jobs.withColumns({
        "status": F.when(own, F.lit(status)).otherwise(F.col("status")),
        "started_at": F.when(own & F.lit(status == "running"), now).otherwise(F.col("started_at")),
        "finished_at": F.when(own & F.lit(ended), now).otherwise(F.col("finished_at")),
        "error_message": F.when(own & F.lit(error is not None), F.lit(error)).otherwise(F.col("error_message")),
    })
    seconds = (F.unix_micros("finished_at") - F.unix_micros(F.coalesce("started_at", "queued_at"))) / 1e6
    store.commit(collection_jobs=out.withColumn("duration_sec", F.when(own & F.lit(ended), seconds).otherwise(F.col("duration_sec"))))


def fail_active(store: Store, error: str = "interrupted") -> int:
    """At start: jobs that were queued or running when the last process ended have failed."""
    jobs = store.read("collection_jobs")
    active = F.col("status").isin("queued", "running")
    n = jobs.where(active).count()
    if n:
        store.commit(collection_jobs=jobs.withColumns({"error_message": F.when(active, F.lit(error)).otherwise(F.col("error_message")), "finished_at": F.when(active, F.current_timestamp()).otherwise(F.col("finished_at")), "status": F.when(active, F.lit("failed")).otherwise(F.col("status"))}))
    return n


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


#: What may be changed of a source after it was made.
EDITABLE = ("name", "is_active", "schedule_type", "schedule_time", "cron_expr", "min_body_length", "allow_non_korean", "config")
DEFAULT_WORKSPACE = "00000000-0000-0000-0000-000000000001"


def create_workspace(store: Store, workspace_id: str, name: str, kind: str = "company", plan: str = "free") -> bool:
    """False if it is there already, so seeding twice changes nothing."""
    uuid.UUID(workspace_id)
    stored = store.read("workspaces")
    if not stored.where(F.col("id") == workspace_id).isEmpty():
        return False
    row = store.spark.createDataFrame([(workspace_id, name, kind, plan)], "id string, name string, type string, plan string").withColumn("created_at", F.current_timestamp())
    store.commit(workspaces=stored.unionByName(row))
    return True


def create_source(store: Store, workspace_id: str, name: str, kind: str, config: dict, min_body_length: int | None = None) -> int:
    """The new source's id; its config is checked and filled up."""
    from textloom.operators.collect import LEAST_BODY
    from textloom.sources.feeds import validated_config

    stored = store.read("sources")
    least = LEAST_BODY[kind] if min_body_length is None else min_body_length
    values = [(0, workspace_id, name.strip(), kind, True, "manual", least, False, json.dumps(validated_config(kind, config), ensure_ascii=False))]
    row = store.spark.createDataFrame(values, "ordinal int, workspace_id string, name string, type string, is_active boolean, schedule_type string, min_body_length int, allow_non_korean boolean, config string")
    new = with_ids(row, stored, ["ordinal"]).drop("ordinal").withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    store.commit(sources=stored.unionByName(new, allowMissingColumns=True))
    return store.read("sources").agg(F.max("id")).first()[0]


def update_source(store: Store, workspace_id: str, source_id: int, **changes) -> bool:
    """False for a source that the tenant does not have. Only EDITABLE columns change; a new config is checked again."""
    from textloom.sources.feeds import validated_config

    if unknown := set(changes) - set(EDITABLE):
        raise ValueError(f"not editable: {sorted(unknown)}")
    if changes.get("schedule_time") is not None and not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", changes["schedule_time"]):
        raise ValueError("schedule_time must be HH:MM")
    stored = store.read("sources")
    own = (F.col("workspace_id") == workspace_id) & (F.col("id") == source_id)
    row = stored.where(own).select("type").first()
    if row is None:
        return False
    if "config" in changes:
        changes["config"] = json.dumps(validated_config(row[0], changes["config"]), ensure_ascii=False)
    new = stored.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})
    store.commit(sources=new.withColumn("updated_at", F.when(own, F.current_timestamp()).otherwise(F.col("updated_at"))))
    return True
