"""Commands over a folder of canonical tables (parquet): each maps to functions of the library."""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.scope import Scope, split_window
from tidewire.functions.times import week_start
from tidewire.operators import correspondence, dossier, edges, graph, reports, seeds, text
from tidewire.sources import archive, files
from tidewire.streaming import ingest as stream


def _table(spark: SparkSession, args, name: str) -> DataFrame:
    return spark.read.parquet(f"{args.data}/{name}")


def _interactions(spark: SparkSession, args) -> DataFrame:
    i = _table(spark, args, "interaction")
    if "window_start" not in i.columns:
        i = i.withColumn("window_start", week_start(F.col("occurred_at")))
    return i if "label" in i.columns else i.withColumn("label", F.lit(None).cast("string"))


def _window(df: DataFrame, args) -> DataFrame:
    """The week asked for, all weeks, or the newest."""
    if args.all:
        return df
    w = args.window or str(df.agg(F.max("window_start")).first()[0])
    return df.where(F.col("window_start") == F.lit(w).cast("date"))


def _analysis(spark: SparkSession, args) -> dict[str, DataFrame]:
    return reports.analyze(edges.aggregate(_window(_interactions(spark, args), args), args.topic), Scope(args.view, core=args.core))


def cmd_fetch(spark, args):
    stream.start(spark, args.source, args.data, args.checkpoint).awaitTermination()


def cmd_load(spark, args):
    for path in archive.extract(args.path, f"{args.data}/_members"):
        events, skipped = archive.scan(spark, path)
        events.write.mode("append").parquet(f"{args.data}/event")
        print(path, "skipped", skipped)


def cmd_inspect(spark, args):
    df = spark.read.parquet(args.path)
    files.describe(df).show(200, False)
    print(files.diagnose(df))


def cmd_aggregate(spark, args):
    i = _window(_interactions(spark, args), args)
    e = edges.aggregate_by_topic(i) if args.by_topic else edges.aggregate(i, args.topic)
    e.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_start", "scope").parquet(f"{args.data}/edge_window")


def cmd_analyze(spark, args):
    for k, df in _analysis(spark, args).items():
        df.write.mode("overwrite").parquet(f"{args.data}/analysis/{k}")


def cmd_dump(spark, args):
    r = _analysis(spark, args)
    reports.wide(r["metrics"]).orderBy(F.desc("pagerank"), "actor_id").limit(args.top).show(args.top, False)
    graph.renumber(r["partition"]).groupBy("community_id").count().orderBy("community_id").show(args.top)
    edges.heaviest(r["edges"], args.top).show(args.top, False)


def cmd_radar(spark, args):
    print(reports.to_json(reports.radar(_window(_interactions(spark, args), args), _analysis(spark, args), args.top), args.out, args.compact))


def cmd_status(spark, args):
    dossier.status(_interactions(spark, args), _table(spark, args, "actor"), args.topic).orderBy("section", F.desc("n"), "item").show(10_000, False)


def cmd_dossier(spark, args):
    """Map, cards and central actors of the newest week or that of ``--window``, as JSON; positions if the folder has them."""
    args.all = False
    r = _analysis(spark, args)
    actors = _table(spark, args, "actor")
    try:
        places = _table(spark, args, "position")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        places = spark.createDataFrame([], "actor_id bigint, dim int, score double")
    p = r["partition"].select("actor_id", "community_id")
    rank = r["metrics"].where("metric = 'pagerank'").select("actor_id", "value")
    m = dossier.network_map(r["edges"], rank)
    parts = {
        "summary": reports.summary(edges.aggregate(_window(_interactions(spark, args), args), args.topic), actors),
        "map": m["summary"],
        "nodes": m["nodes"].join(p, "actor_id", "left").join(actors.select("actor_id", "handle", "tier"), "actor_id", "left"),
        "links": m["links"],
        "axis": correspondence.chosen_dimension(correspondence.agreement(places, p), places),
        "communities": dossier.community_cards(r["communities"], p, places).orderBy(F.desc("size"), "community_id"),
        "actors": reports.top_actors(r["metrics"], actors, top=args.top),
    }
    print(reports.to_json(parts, args.out, args.compact))


def cmd_export(spark, args):
    i = _window(_interactions(spark, args), args)
    days = {str(w): n for w, n in i.groupBy("window_start").agg(F.count_distinct(F.to_date("occurred_at"))).collect()}
    runs = i.groupBy("label").agg(F.count(F.lit(1)).alias("posts"))
    print(reports.export(_analysis(spark, args), edges.aggregate(i, args.topic), runs, days, args.out, core=args.core))


def cmd_compare(spark, args):
    parts = []
    for x in (args.a, args.b):
        w, s = split_window(x)
        e = edges.aggregate(_interactions(spark, args), window=w)
        parts.append(reports.analyze(e, Scope.parse(s)))
    a, b = parts
    reports.compare(a["partition"], b["partition"], a["communities"], b["communities"]).show(args.top, False)


def cmd_candidates(spark, args):
    seeds.candidates(_interactions(spark, args), args.top).show(args.top, False)


def cmd_themes(spark, args):
    text.propose_themes(_table(spark, args, "post").withColumnRenamed("post_uid", "post_id"))[0].show(args.top, False)


COMMANDS = {k.removeprefix("cmd_"): f for k, f in list(globals().items()) if k.startswith("cmd_")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewire")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        s = sub.add_parser(name)
        s.add_argument("--data", default="data")
        s.add_argument("--window")
        s.add_argument("--all", action="store_true")
        s.add_argument("--view", default="amp")
        s.add_argument("--core", action="store_true")
        s.add_argument("--topic", action="append")
        s.add_argument("--by-topic", action="store_true")
        s.add_argument("--top", type=int, default=20)
        s.add_argument("--out")
        s.add_argument("--compact", action="store_true")
        if name == "fetch":
            s.add_argument("--source", required=True)
            s.add_argument("--checkpoint", required=True)
        if name in ("load", "inspect"):
            s.add_argument("path")
        if name == "compare":
            s.add_argument("a")
            s.add_argument("b")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidewire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    COMMANDS[args.command](spark, args)


if __name__ == "__main__":
    main()
