"""Running the catalog and deriving a snapshot from it."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from threading import Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.functions.dates import moment, ntz
from wardlight.operators import alerts as alerting
from wardlight.operators import annotations, findings, metrics
from wardlight.plans.catalog import FACTS, Query, catalog, find
from wardlight.schemas import schema
from wardlight.session import shared_folder, written
from wardlight.sources.versions import PART, drop, read_parts, replace_parts

_PLACE = "place_in_result"


def query_label(key: str) -> str:
    """Readable name of a query: words capitalised, also after a digit."""
    return " ".join(word.title() for word in key.split("_") if word)


class RunTables(Mapping):
    """The tables of a run, and the catalog's ``FACTS`` as of its moment.

    A fact is made when the first query asks for it, stored below ``folder``, and read
    from there by all.  Who fails to make one leaves that to the next.
    """

    def __init__(self, tables: Mapping[str, DataFrame], as_of: datetime, folder: str):
        self._tables, self._as_of, self._folder = tables, as_of, folder
        self._made: dict[str, DataFrame] = {}
        self._locks = {name: Lock() for name in FACTS}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in FACTS:
            return self._tables[name]
        with self._locks[name]:
            if name not in self._made:
                fact, path = FACTS[name](self, self._as_of), f"{self._folder}/{name}"
                fact.write.mode("overwrite").parquet(path)
                self._made[name] = fact.sparkSession.read.schema(fact.schema).parquet(path)
            return self._made[name]

    def __contains__(self, name: object) -> bool:  # asking makes nothing
        return name in FACTS or name in self._tables

    def __iter__(self) -> Iterator[str]:
        return iter([*self._tables, *FACTS])

    def __len__(self) -> int:
        return len(self._tables) + len(FACTS)

    def drop(self, spark: SparkSession) -> None:
        """Remove the facts that were made."""
        if self._made:
            drop(spark, self._folder)


def run_query(
    query: Query, tables: Mapping[str, DataFrame], as_of: datetime, folder: str, sample: int = fixed.SAMPLE_ROWS,
) -> tuple[tuple, DataFrame | None]:
    """One run-log row, and the result.  A failure is logged, not raised.

    The query runs once: its rows are counted while they are written to ``folder``,
    with their place, and the sample and every later use read them from there.
    Detail queries are not stored; theirs are a top list and a count.
    """
    names: list[str] = []
    head: list[str] = []
    count, error, stored = 0, None, None
    try:
        result = query.build(tables, as_of)
        names = result.columns
        as_json = F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"}).alias("row")
        if query.detail:
            head = [r.row for r in result.select(as_json).limit(sample + 1).collect()]
            count = len(head) if len(head) <= sample else result.count()
        else:
            noted = Observation()
            placed = result.withColumn(_PLACE, F.monotonically_increasing_id()).observe(noted, F.count(F.lit(1)).alias("n"))
            placed.write.mode("overwrite").parquet(f"{folder}/{query.key}")
            stored = result.sparkSession.read.schema(placed.schema).parquet(f"{folder}/{query.key}")
            count = noted.get["n"]
            head = [r.row for r in stored.orderBy(_PLACE).limit(sample).select(as_json).collect()] if count else []
            stored = stored.drop(_PLACE)
        names = names if count else []
    except Exception as failure:  # noqa: BLE001 - any failure belongs in the log
        names, head, count, error, stored = [], [], 0, str(failure) or type(failure).__name__, None
    return (query.area, query.key, query_label(query.key), count, names, head[:sample], count > sample, error), stored


def run_catalog_results(
    spark: SparkSession, tables: Mapping[str, DataFrame], as_of: datetime | str,
    queries: Iterable[Query] | None = None, parallel: int = 4, folder: str | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The run log with one row per catalog query, and the stored results of those that did not fail, by key.

    ``parallel`` queries share the cluster at a time.  Results go to ``folder``, by
    default a new one below the shared folder; who runs it owns and removes it.
    Facts that several queries look at are stored for the time of the run.
    """
    at, out = moment(as_of), folder or shared_folder(spark, "results")
    own = RunTables(tables, at, shared_folder(spark, "facts"))
    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(lambda q: run_query(q, own, at, out), catalog() if queries is None else queries))
    own.drop(spark)
    log = spark.createDataFrame([row for row, _ in done], schema("run_log"))
    return log, {row[1]: result for row, result in done if result is not None}


def run_catalog(
    spark: SparkSession, tables: Mapping[str, DataFrame], as_of: datetime | str,
    queries: Iterable[Query] | None = None, parallel: int = 4,
) -> DataFrame:
    """The run log alone; the results are removed again."""
    folder = shared_folder(spark, "results")
    log, _ = run_catalog_results(spark, tables, as_of, queries, parallel, folder)
    drop(spark, folder)
    return log


# The catalog queries that the metrics come from.
METRIC_SOURCES = {
    "period_indicators": "internacao_e_altas", "deaths": "obitos_mes", "reception_queue": "fila_recepcao",
    "triage_queue": "fila_triagem", "admitted_now": "internados", "surgery_status": "cirurgias_status_mes",
    "product_months": "medicamentos_alto_risco",
}


def snapshot_metrics(
    spark: SparkSession, tables: Mapping[str, DataFrame], as_of: datetime | str, unit_id: int = 1,
    failed: Collection[str] = (), done: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """The metric table of one moment and unit, from seven catalog queries.

    Results in ``done`` are taken as they are.  Queries in ``failed`` are not run
    again; their metrics are NULL.
    """
    at = moment(as_of)
    stamp = {"as_of": ntz(at), "unit_id": F.lit(unit_id).cast("bigint")}
    results = {"snapshot": spark.range(1).select(*[c.alias(n) for n, c in stamp.items()])}
    for name, key in METRIC_SOURCES.items():
        if key not in failed:
            result = done[key] if done and key in done else find(key).build(tables, at)
            results[name] = result.withColumnRenamed("qtde_pacientes_fila", "n").withColumns(stamp)
    return metrics.metric_table(results, failed=[name for name, key in METRIC_SOURCES.items() if key in failed])


def snapshot(
    spark: SparkSession, tables: Mapping[str, DataFrame], as_of: datetime | str, unit_id: int = 1,
    alert_notes: DataFrame | None = None, extra_alerts: DataFrame | None = None, run_notes: DataFrame | None = None,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """Run log, metrics, status, alerts and findings of one moment.

    Reviewers' annotations (schemas ``alert_notes``, ``alert_additions`` and
    ``run_notes``) are merged where given.  Alerts that then break the alert
    contract go to ``quarantine``.
    Each query runs once; its result is stored and feeds the metrics (results stay in
    ``folder``, if given).  The metrics feed everything else, so they are computed once and written.  A
    query that fails is in the run log and raises its alert; the metrics that come
    from it are NULL and everything else is there.
    """
    at = moment(as_of)
    out = folder or shared_folder(spark, "results")
    run_log, done = run_catalog_results(spark, tables, at, folder=out)
    run_log = run_log.withColumns({"as_of": ntz(at), "unit_id": F.lit(unit_id).cast("bigint")})
    failed = [r.query_key for r in run_log.where("error is not null").select("query_key").collect()]  # of 34 rows at most
    table = written(snapshot_metrics(spark, tables, at, unit_id, failed, done), "metrics")
    if folder is None:
        drop(spark, out)
    names = metrics.metric_catalog(spark)
    raised = (
        alerting.threshold_alerts(table, alerting.threshold_rules(spark))
        .unionByName(alerting.collection_failure_alerts(run_log))
        .unionByName(alerting.cross_alerts(table))
    )
    if alert_notes is not None:
        raised = annotations.annotate_alerts(raised, alert_notes)
    if extra_alerts is not None:
        here = {"as_of": ntz(at), "unit_id": F.lit(unit_id).cast("bigint")}
        raised = annotations.add_alerts(raised, extra_alerts.withColumns(here))
    checked = alerting.check_alerts(raised)
    raised = checked.filter("problem is null").drop("problem")
    classified = findings.classify_runs(run_log)
    if run_notes is not None:
        classified = annotations.reclassify_runs(classified, run_notes)
    return {
        "run_log": classified,
        "quarantine": checked.filter("problem is not null"),
        "metrics": table,
        "status": metrics.metric_status(table, names),
        "pressure": metrics.area_pressure(table, names),
        "alerts": alerting.alert_order(alerting.link_alert_metric(raised, table, names)),
        "findings": findings.cross_findings(run_log, table),
        "summary": findings.run_summary(run_log, raised, ("as_of", "unit_id")),
    }


# The history of snapshots.

def snapshot_part(as_of: datetime | str, unit_id: int) -> str:
    """Name of a snapshot in the history; names sort by time."""
    return f"{moment(as_of):%Y-%m-%dT%H-%M-%S.%f}_{unit_id}"


def save_snapshot(result: Mapping[str, DataFrame], folder: str, as_of: datetime | str, unit_id: int = 1) -> None:
    """Put the tables of a snapshot into the history below ``folder``, all in one step.

    A snapshot that is saved again takes the place of the one before, also where it
    now has no rows; one that fails on the way leaves the one before.
    """
    part = snapshot_part(as_of, unit_id)
    replace_parts({name: df.withColumn(PART, F.lit(part)) for name, df in result.items()}, folder, [part])


def read_history(
    spark: SparkSession, folder: str, table: str, since: datetime | str | None = None, before: datetime | str | None = None,
) -> DataFrame:
    """A table of all saved snapshots from ``since`` on and earlier than ``before``; only their parts are read."""
    first = None if since is None else snapshot_part(since, 0).rsplit("_", 1)[0]
    last = None if before is None else snapshot_part(before, 0).rsplit("_", 1)[0]
    return read_parts(spark, folder, table, first, last).drop(PART)
