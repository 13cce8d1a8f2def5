"""Sequences, windows, queues and states over events and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.functions.rounding import cents
from kvartal.operators import events as E
from kvartal.operators.seq import islands
from kvartal.plans.registry import query
from kvartal.sources.tables import read

START = 1_704_067_200  # 2024-01-01, when the scenario's clock is 0
AT = 10 * 86400
_EV = f"e AS (SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, CAST(epoch_us(ts) // 1000000 AS BIGINT) - {START} AS t FROM events)"


def clock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole seconds since the scenario's midnight."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", cents(F.col("value")).alias("cents"), (F.unix_seconds("ts") - START).alias("t"))


def _by_user() -> W.WindowSpec:
    return W.Window.partitionBy("user_id").orderBy("t", "event_id")


@query("way_segments", f"WITH {_EV} SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS seg FROM e")
def way_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences cut after their cutting rows; null before any row."""
    cut = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(_by_user().rowsBetween(W.Window.unboundedPreceding, -1))
    return clock_events(spark, sf_dir).select("user_id", "event_id", cut.alias("seg"))


@query("dedupe_consecutive", f"WITH {_EV} SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e) WHERE p IS DISTINCT FROM event_type")
def dedupe_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each run of equal neighbours."""
    e = clock_events(spark, sf_dir).withColumn("p", F.lag("event_type").over(_by_user()))
    return e.where(~F.col("event_type").eqNullSafe(F.col("p"))).select("user_id", "event_id", "event_type")


@query("route_pieces", f"WITH {_EV}, i AS (SELECT *, CAST(sum(CASE WHEN t - p > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS piece FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e)) SELECT user_id, piece, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM i GROUP BY user_id, piece")
def route_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands: pieces part where more than half a day passes. One sort serves both windows."""
    e = clock_events(spark, sf_dir).withColumn("p", F.lag("t").over(_by_user()))
    runs = islands(e, ["user_id"], ["t", "event_id"], F.col("t") - F.col("p") > 43200, "piece")
    return runs.groupBy("user_id", "piece").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("boundary_transitions", f"WITH {_EV} SELECT user_id, event_id, inside FROM (SELECT *, cents BETWEEN 2000 AND 8000 AS inside, lag(cents BETWEEN 2000 AND 8000) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e) WHERE inside <> p")
def boundary_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a sequence enters or leaves the region."""
    e = clock_events(spark, sf_dir).withColumn("inside", F.col("cents").between(2000, 8000))
    return e.withColumn("p", F.lag("inside").over(_by_user())).where("inside <> p").select("user_id", "event_id", "inside")


@query("ring_journal", f"WITH {_EV} SELECT user_id, event_id, CAST(r AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS r FROM e) WHERE r <= 5")
def ring_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five records of each user."""
    return E.last_n(clock_events(spark, sf_dir), "user_id", [F.col("t").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id", "back")


@query("latest_schedule_wins", f"WITH {_EV} SELECT user_id, event_type, arg_max(event_id, (t, event_id)) AS event_id, max(t) AS t FROM e GROUP BY user_id, event_type")
def latest_schedule_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pending event for each entity: the last that was scheduled."""
    return E.latest(clock_events(spark, sf_dir).select("user_id", "event_type", "event_id", "t"), ["user_id", "event_type"], ["t", "event_id"])


@query("late_drop", f"WITH {_EV} SELECT event_id, t FROM (SELECT event_id, t, max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e) WHERE seen IS NULL OR t >= seen - 3600")
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events older than what their entity has seen, less an hour, are refused."""
    seen = F.max("t").over(W.Window.partitionBy("user_id").orderBy("event_id").rowsBetween(W.Window.unboundedPreceding, -1))
    return clock_events(spark, sf_dir).withColumn("seen", seen).where("seen IS NULL OR t >= seen - 3600").select("event_id", "t")


@query("interval_tumble", f"WITH {_EV} SELECT t - t % 300 AS b, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY 1, 2")
def interval_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed intervals of the clock."""
    e = clock_events(spark, sf_dir)
    return e.groupBy((F.col("t") - F.pmod(F.col("t"), F.lit(300))).alias("b"), "event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("command_boundary", f"WITH {_EV} SELECT event_id, b, row_number() OVER (PARTITION BY b ORDER BY t, event_id) - 1 AS seq FROM (SELECT *, (t + 299) // 300 * 300 AS b FROM e)")
def command_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands take effect at the next interval, in the order they were given."""
    b = F.col("t") + F.pmod(-F.col("t"), F.lit(300))
    seq = F.row_number().over(W.Window.partitionBy("b").orderBy("t", "event_id")) - 1
    return clock_events(spark, sf_dir).withColumn("b", b).select("event_id", "b", seq.cast("long").alias("seq"))


@query("fifo_queue", f"WITH {_EV} SELECT user_id % 10 AS stop, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY t, event_id) AS place FROM e")
def fifo_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the queue of a stop."""
    w = W.Window.partitionBy("stop").orderBy("t", "event_id")
    return clock_events(spark, sf_dir).withColumn("stop", F.col("user_id") % 10).select("stop", "event_id", F.row_number().over(w).cast("long").alias("place"))


_BOARD = f"""WITH RECURSIVE {_EV}, q AS (SELECT user_id % 10 AS stop, t, event_id AS id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY t, event_id) AS rank FROM e),
v AS (SELECT s AS stop, k, k * 14400 + s * 600 AS depart, 2 + (k + s) % 3 AS seats FROM range(0, 10) a(s), range(0, 180) b(k)),
c AS (SELECT v.*, (SELECT count(*) FROM q WHERE q.stop = v.stop AND q.t <= v.depart) AS a FROM v),
r AS (SELECT stop, k, least(seats, a) AS b FROM c WHERE k = 0 UNION ALL SELECT c.stop, c.k, least(r.b + c.seats, c.a) FROM r JOIN c ON c.stop = r.stop AND c.k = r.k + 1)"""


def _queues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Arrivals at stops, and vehicles with their seats."""
    arrivals = clock_events(spark, sf_dir).select((F.col("user_id") % 10).alias("stop"), "t", F.col("event_id").alias("id"))
    v = spark.range(10).select(F.col("id").alias("stop"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(179).cast("long"))).alias("k"))
    return arrivals, v.select("stop", "k", (F.col("k") * 14400 + F.col("stop") * 600).alias("depart"), (2 + (F.col("k") + F.col("stop")) % 3).alias("seats"))


@query("capacity_boarding", _BOARD + " SELECT q.stop, q.id, q.rank, min(r.k) AS k FROM q LEFT JOIN r ON r.stop = q.stop AND r.b >= q.rank GROUP BY ALL")
def capacity_boarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vehicle each waiting person boards, seats being few."""
    return E.boarding(*_queues(spark, sf_dir), "stop")


_LEAVE = f"""WITH RECURSIVE {_EV}, q AS (SELECT user_id % 10 AS stop, t, event_id AS id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY t, event_id) AS rank FROM e),
v AS (SELECT s AS stop, k, k * 14400 + s * 600 AS depart, 2 + (k + s) % 3 AS seats FROM range(0, 10) a(s), range(0, 180) b(k)),
c AS (SELECT v.*, (SELECT count(*) FROM q WHERE q.stop = v.stop AND q.t <= v.depart) AS came, (SELECT count(*) FROM q WHERE q.stop = v.stop AND q.t < v.depart - 20000) AS gone FROM v),
r AS (SELECT stop, k, gone AS lo, greatest(gone, least(came, gone + seats)) AS hi FROM c WHERE k = 0
UNION ALL SELECT c.stop, c.k, greatest(r.hi, c.gone), greatest(r.hi, c.gone, least(c.came, greatest(r.hi, c.gone) + c.seats)) FROM r JOIN c ON c.stop = r.stop AND c.k = r.k + 1)"""


@query("wait_timeout", _LEAVE + " SELECT q.id, r.k, CAST(v.depart - q.t AS BIGINT) AS wait, r.k IS NULL AS gives_up FROM q LEFT JOIN r ON r.stop = q.stop AND q.rank > r.lo AND q.rank <= r.hi LEFT JOIN v ON v.stop = q.stop AND v.k = r.k")
def wait_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who boards which vehicle where those who wait longer than the limit leave the queue."""
    arrivals, v = _queues(spark, sf_dir)
    got = E.boarding_with_limit(arrivals, v, "stop", 20000)
    depart = v.select(F.col("stop").alias("_s"), F.col("k").alias("_k"), "depart")
    both = got.join(depart, (F.col("stop") == F.col("_s")) & (F.col("k") == F.col("_k")), "left").join(arrivals.select(F.col("id").alias("_i"), "t"), F.col("id") == F.col("_i"))
    return both.select("id", "k", (F.col("depart") - F.col("t")).alias("wait"), F.col("k").isNull().alias("gives_up"))


_PRES = "p AS (SELECT user_id, event_type AS grp, t AS since, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), 2592000) AS until FROM e)"


@query("presence_intervals", f"WITH {_EV}, {_PRES} SELECT user_id, grp, since, until FROM p")
def presence_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each change to the next, who was in which group."""
    until = F.coalesce(F.lead("t").over(_by_user()), F.lit(30 * 86400))
    return clock_events(spark, sf_dir).select("user_id", F.col("event_type").alias("grp"), F.col("t").alias("since"), until.cast("long").alias("until"))


@query("group_sizes", f"WITH {_EV}, {_PRES}, d AS (SELECT grp, since AS t, 1 AS n FROM p UNION ALL SELECT grp, until, -1 FROM p), s AS (SELECT grp, t, sum(n) AS n FROM d GROUP BY grp, t) SELECT grp, CAST(max(c) AS BIGINT) AS most FROM (SELECT grp, sum(n) OVER (PARTITION BY grp ORDER BY t) AS c FROM s) GROUP BY grp")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most riders at once, by a running sum of comings and goings that are first added up for each second."""
    p = presence_intervals(spark, sf_dir)
    steps = p.select("grp", F.explode(F.array(F.struct(F.col("since").alias("t"), F.lit(1).alias("n")), F.struct(F.col("until").alias("t"), F.lit(-1).alias("n")))).alias("d"))
    per = steps.groupBy("grp", "d.t").agg(F.sum("d.n").alias("n"))
    now = F.sum("n").over(W.Window.partitionBy("grp").orderBy("t"))
    return per.withColumn("c", now).groupBy("grp").agg(F.max("c").alias("most"))


@query("state_asof", f"WITH {_EV} SELECT user_id, arg_max(event_type, (t, event_id)) AS state, max(t) AS since FROM e WHERE t <= {AT} GROUP BY user_id")
def state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's state at a time."""
    return E.state_asof(clock_events(spark, sf_dir), "user_id", "t", AT, ["event_id"]).select("user_id", F.col("event_type").alias("state"), F.col("t").alias("since"))


@query("state_counts", f"WITH {_EV}, s AS (SELECT user_id, arg_max(event_type, (t, event_id)) AS state FROM e WHERE t <= {AT} GROUP BY user_id) SELECT state, count(*) AS n FROM s GROUP BY state")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_asof(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query("active_at", f"WITH {_EV}, {_PRES} SELECT grp, count(*) AS n FROM p WHERE since <= {AT} AND until > {AT} GROUP BY grp")
def active_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that hold a time."""
    return presence_intervals(spark, sf_dir).where((F.col("since") <= AT) & (F.col("until") > AT)).groupBy("grp").agg(F.count("*").alias("n"))


@query(
    "tile_snapshot",
    f"WITH {_EV}, s AS (SELECT user_id, arg_max(cents, (t, event_id)) AS cents, arg_max(event_type, (t, event_id)) AS state FROM e WHERE t <= {AT} GROUP BY user_id) SELECT CASE WHEN cents < 10000 THEN cents // 2000 ELSE -1 END AS tile, count(*) AS present, count(*) FILTER (state = 'view') AS moving FROM s GROUP BY 1",
)
def tile_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of tiles at a time; what lies beyond the grid is tile -1."""
    s = E.state_asof(clock_events(spark, sf_dir), "user_id", "t", AT, ["event_id"])
    tile = F.when(F.col("cents") < 10000, F.floor(F.col("cents") / 2000)).otherwise(-1)
    return s.groupBy(tile.cast("long").alias("tile")).agg(F.count("*").alias("present"), F.count_if(F.col("event_type") == "view").alias("moving"))


@query("points_capped", f"WITH {_EV} SELECT user_id, (SELECT count(DISTINCT user_id) FROM e WHERE t <= {AT}) AS total FROM (SELECT DISTINCT user_id FROM e WHERE t <= {AT}) ORDER BY user_id LIMIT 40")
def points_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty points in order of id, with how many there are."""
    ids = clock_events(spark, sf_dir).where(F.col("t") <= AT).select("user_id").distinct()
    return ids.orderBy("user_id").limit(40).join(F.broadcast(ids.agg(F.count("*").alias("total"))))


@query(
    "placement_interp",
    f"WITH {_EV}, n AS (SELECT user_id, t, cents, lead(t) OVER w AS t2, lead(cents) OVER w AS c2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, CAST(cents + floor((c2 - cents) * ({AT} - t) / CAST(t2 - t AS DOUBLE)) AS BIGINT) AS place FROM n WHERE t <= {AT} AND t2 > {AT}",
)
def placement_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where those on the way are, between the last stop and the next."""
    e = clock_events(spark, sf_dir).withColumn("t2", F.lead("t").over(_by_user())).withColumn("c2", F.lead("cents").over(_by_user()))
    place = F.col("cents") + F.floor((F.col("c2") - F.col("cents")) * (F.lit(AT) - F.col("t")) / (F.col("t2") - F.col("t")))
    return e.where((F.col("t") <= AT) & (F.col("t2") > AT)).select("user_id", place.alias("place"))
