"""Race tables derived from the ``events`` table by Spark.

22 users make one session, a user is a driver and a user's n-th event is lap n.
``catalog.views`` states the same tables in SQL for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise import schemas
from stintwise.functions.scoring import StackParams, confidence, stack_probability
from stintwise.operators.laps import pit_count_so_far
from stintwise.operators.series import Series, lap_series, series, with_position, with_running, with_totals
from stintwise.session import written

c = F.col
DRIVER = ["session_key", "driver_number"]
TEAMS = [
    "McLaren", "Ferrari", "Red Bull", "Mercedes", "Williams", "Aston Martin",
    "Alpine", "Haas", "Racing Bulls", "Audi", "Cadillac", "Unknown",
]


def fixture_team(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TEAMS]), (n % 12 + 1).cast("int"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, events: DataFrame | None = None, feed: DataFrame | None = None):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        if events is not None:
            self.events = events
        if feed is not None:
            self.feed = feed

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.schema(schemas.EVENTS).parquet(f"{self.dir}/events.parquet")

    def stored(self) -> Tables:
        """The same tables over laps written once, for plans that read many of them.

        One write replaces a scan and an exchange of all events per table.
        """
        kept = Tables(self.spark, self.dir, feed=self.feed)
        kept.base = written(self.base, "laps")
        return kept

    @staticmethod
    def to_feed(events: DataFrame) -> DataFrame:
        """Events as telemetry records, without lap numbers (filters still reach the scan)."""
        return events.select(
            (F.floor(c("user_id") / 22.0).cast("bigint") + 9000).alias("session_key"),
            c("user_id").cast("int").alias("driver_number"),
            "event_id",
            c("ts").alias("event_time"),
            "event_type",
            "value",
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        )

    @cached_property
    def feed(self) -> DataFrame:
        return self.to_feed(self.events)

    @cached_property
    def base(self) -> DataFrame:
        timed = series(self.feed, DRIVER, ["event_time", "event_id"], measure=self.feed.select(*DRIVER))
        return with_position(timed, "lap_number").withColumn("lap_number", c("lap_number").cast("int"))

    @cached_property
    def laps(self) -> DataFrame:
        kind, k, value = c("event_type"), c("k"), c("value")
        text = value.cast("string")
        stop = (kind == "purchase") & (k % 5 == 0)
        return self.base.select(
            *DRIVER,
            "lap_number",
            "event_time",
            F.when(~((kind == "signup") & (k % 10 == 0)), 28.0 + (value % 10) / 4).alias("duration_sector_1"),
            (90.0 + (value % 10)).alias("lap_duration"),
            F.when(stop, 1).otherwise(0).alias("did_pit"),
            F.when(stop, c("lap_number")).alias("pit_lap"),
            F.when(k == 0, F.lit(None))
            .when(k == 99, "+1 LAP")
            .when(k % 2 == 0, F.concat(F.lit("+"), text))
            .otherwise(text)
            .alias("gap_raw"),
            (18.0 + k % 22).alias("air_temperature"),
            (30.0 + k % 30).alias("track_temperature"),
            (k % 12 == 0).alias("rainfall"),
            ((kind == "error") & (k < 10)).alias("had_incident"),
            F.when((kind == "error") & (k >= 40) & (k < 98), 1).otherwise(0).alias("yellow_flag_count"),
            "k",
            "value",
            "event_id",
        )

    def by_lap(self, rows: DataFrame) -> Series:
        """Laps of each driver; a driver has as many as feed records, so the feed is measured."""
        return lap_series(rows, measure=self.feed.select(*DRIVER))

    @cached_property
    def laps_in_stints(self) -> DataFrame:
        """Laps with their stint number and compound."""
        rows = with_running(self.by_lap(self.laps), sums={"_pits": pit_count_so_far()})
        code = (c("driver_number") + c("stint_number")) % 5
        return (
            rows.withColumn("stint_number", (c("_pits") + 1).cast("int"))
            .drop("_pits")
            .withColumn(
                "compound",
                F.when(code == 0, "SOFT").when(code == 1, "MEDIUM").when(code == 2, "hard").when(code == 3, "INTERMEDIATE"),
            )
        )

    @cached_property
    def stints(self) -> DataFrame:
        per_stint = (
            self.laps_in_stints.groupBy(*DRIVER, "stint_number", "compound")
            .agg(F.min("lap_number").alias("lap_start"), F.max("lap_number").alias("_end"))
        )
        newest = per_stint.groupBy(*DRIVER).agg(F.max("stint_number").alias("_newest"))
        return per_stint.join(newest, DRIVER).select(
            *DRIVER,
            "stint_number",
            "lap_start",
            F.when(c("stint_number") != c("_newest"), c("_end")).alias("lap_end"),
            "compound",
        )

    @cached_property
    def raw_laps(self) -> DataFrame:
        """The batch job's input: laps with weather, gap text and compound."""
        return self.laps_in_stints.select(
            *DRIVER,
            "lap_number",
            "event_time",
            "duration_sector_1",
            "lap_duration",
            "did_pit",
            "pit_lap",
            c("gap_raw").alias("gap_to_leader"),
            "air_temperature",
            "track_temperature",
            "rainfall",
            "had_incident",
            "yellow_flag_count",
            c("compound").alias("tyre_compound"),
            F.concat(F.lit("circuit_"), (c("session_key") % 5).cast("string")).alias("circuit_id"),
            (57 + c("session_key") % 3).cast("int").alias("total_laps"),
        )

    @cached_property
    def race_control(self) -> DataFrame:
        k = c("k")
        return self.base.where(c("event_type") == "error").select(
            "session_key",
            "event_id",
            c("event_time").alias("date"),
            "lap_number",
            F.when(k < 5, "SC")
            .when(k < 8, "VSC")
            .when(k < 10, F.lit(None))
            .when(k < 40, "GREEN")
            .when(k < 98, "YELLOW")
            .otherwise("CHEQUERED")
            .alias("flag"),
            F.when(k < 5, "Safety Car deployed")
            .when(k < 8, "VSC deployed")
            .when(k < 10, "Virtual Safety Car ending")
            .when(k < 40, "Green flag")
            .when(k < 98, F.concat(F.lit("Yellow in sector "), (k % 20).cast("string")))
            .otherwise("Chequered flag")
            .alias("message"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        return self.feed.where(c("event_type") == "view").select(
            "session_key",
            "event_id",
            c("event_time").alias("date"),
            (18.0 + c("k") % 22).alias("air_temperature"),
            (30.0 + c("k") % 30).alias("track_temperature"),
            (c("k") % 12 == 0).alias("rainfall"),
        )

    @cached_property
    def car_data(self) -> DataFrame:
        return self.feed.where(c("event_type") == "click").select(
            *DRIVER,
            "event_id",
            c("event_time").alias("date"),
            c("value").alias("speed"),
            c("k").alias("throttle"),
            (100 - c("k")).alias("brake"),
            (c("k") % 15).alias("drs"),
            (c("k") % 9).alias("n_gear"),
        )

    @cached_property
    def pit(self) -> DataFrame:
        return self.base.where((c("event_type") == "purchase") & (c("k") % 5 == 0)).select(
            *DRIVER,
            "lap_number",
            (18.0 + c("k") / 4.0).alias("pit_duration"),
            (c("k") % 15 == 0).alias("pit_out_lap"),
        )

    @cached_property
    def intervals(self) -> DataFrame:
        return self.laps.where(c("k") % 4 != 1).select(
            *DRIVER, "lap_number", c("gap_raw").alias("gap_to_leader"), c("event_time").alias("date")
        )

    @cached_property
    def scores(self) -> DataFrame:
        return self.base.select(
            "event_id",
            *DRIVER,
            "lap_number",
            "event_time",
            (c("k") / 100.0).alias("p_xgb"),
            ((c("value") % 50) / 50).alias("p_lgb"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Prediction events: one per driver and lap."""
        rows = with_totals(
            self.by_lap(self.laps_in_stints), {"lap_start": F.min("lap_number")}, extra=("stint_number",)
        )
        p = F.round(stack_probability(c("k") / 100.0, (c("value") % 50) / 50, StackParams()), 4)
        gap = F.replace(c("gap_raw"), F.lit("+"), F.lit("")).try_cast("double")
        note = F.concat(F.lit("note "), c("event_id").cast("string"))
        return rows.select(
            *DRIVER,
            F.concat(F.lit("Driver #"), c("driver_number").cast("string")).alias("driver_name"),
            fixture_team(c("driver_number")).alias("team"),
            F.coalesce("compound", F.lit("UNKNOWN")).alias("tyre_compound"),
            (c("lap_number") - c("lap_start")).alias("tyre_age"),
            "stint_number",
            (c("stint_number") - 1).alias("pits_completed"),
            "lap_number",
            c("event_time").alias("ts"),
            F.coalesce(gap, F.lit(0.0)).alias("gap_to_leader"),
            c("value").alias("speed"),
            c("k").alias("throttle"),
            (c("k") % 15 >= 10).alias("drs_active"),
            (c("k") < 3).alias("safety_car_active"),
            p.alias("pitstop_probability"),
            F.round(confidence(p), 4).alias("confidence"),
            ((c("value") % 100) / 1000).alias("win_probability"),
            F.when(c("k") % 3 == 0, "").otherwise(note).alias("commentary"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        """Race results: one row per driver and session, the position model's input."""
        n = c("driver_number")
        return (
            self.base.groupBy(*DRIVER)
            .agg(
                F.count(F.lit(1)).alias("laps"),
                F.count_if((c("event_type") == "purchase") & (c("k") % 5 == 0)).alias("pits"),
                F.max("k").alias("top_k"),
            )
            .select(
                *DRIVER,
                (n % 22 + 1).cast("double").alias("grid_position"),
                (c("top_k") / 64.0).alias("qualifying_delta_to_pole"),
                c("pits").cast("int").alias("pit_count"),
                (c("laps") / (c("pits") + 1)).alias("avg_stint_length"),
                F.when(c("session_key") % 3 == 0, "street")
                .when(c("session_key") % 3 == 1, "permanent")
                .otherwise("hybrid")
                .alias("circuit_type"),
                fixture_team(n).alias("team"),
                F.when(n % 6 == 0, "SOFT-MEDIUM")
                .when(n % 6 == 1, "SOFT-HARD")
                .when(n % 6 == 2, "MEDIUM-HARD")
                .when(n % 6 == 3, "ONE-STOP")
                .when(n % 6 == 4, "TWO-STOP")
                .alias("tyre_strategy"),
                (c("top_k") / 128.0).alias("weather_impact_score"),
                F.when(n % 11 != 0, (n * 7) % 22 + 1).cast("int").alias("final_position"),
            )
        )

    @cached_property
    def positions(self) -> DataFrame:
        return self.feed.where(c("event_type") == "signup").select(
            *DRIVER, c("event_time").alias("date"), c("value").alias("x"), c("k").cast("double").alias("y")
        )

    @cached_property
    def session_documents(self) -> DataFrame:
        """Raw documents: one per driver and block of 256 laps, and one per session and 4096 events.

        A session thus comes as several documents, none of which grows with the race.
        """
        block = F.floor(c("lap_number") / 256).alias("_block")
        lap = F.struct(
            "lap_number",
            c("event_time").cast("timestamp").alias("date_start"),
            "duration_sector_1",
            "lap_duration",
        )
        interval = F.struct(
            "lap_number", c("gap_raw").alias("gap_to_leader"), c("event_time").cast("timestamp").alias("date")
        )
        stop = F.struct(
            "lap_number", (18.0 + c("k") / 4.0).alias("pit_duration"), (c("k") % 15 == 0).alias("pit_out_lap")
        )
        driven = self.laps.groupBy(*DRIVER, block).agg(
            F.sort_array(F.collect_list(lap)).alias("laps"),
            F.sort_array(F.collect_list(F.when(c("k") % 4 != 1, interval))).alias("intervals"),
            F.sort_array(F.collect_list(F.when(c("did_pit") == 1, stop))).alias("pit"),
        )
        stint = F.struct("stint_number", "lap_start", "lap_end", "compound")
        laid = self.stints.groupBy(*DRIVER, F.floor(c("lap_start") / 256).alias("_block")).agg(
            F.sort_array(F.collect_list(stint)).alias("stints")
        )
        # Positions carry no lap: a driver's are cut by day, into documents of their own.
        point = F.struct(c("date").cast("timestamp").alias("date"), "x", "y")
        tracked = self.positions.groupBy(*DRIVER, F.to_date("date").alias("_day")).agg(
            F.sort_array(F.collect_list(point)).alias("position")
        )
        drivers = driven.join(laid, [*DRIVER, "_block"], "left").unionByName(tracked, allowMissingColumns=True)
        tables = F.struct("laps", "stints", "intervals", "position", "pit")
        per_driver = drivers.select(
            "session_key", F.lit(2024).alias("year"), F.create_map(c("driver_number").cast("string"), tables).alias("drivers")
        )
        at = c("date").cast("timestamp")
        part = F.floor(c("event_id") / 4096).alias("_part")
        readings = self.weather.groupBy("session_key", part).agg(
            F.sort_array(
                F.collect_list(F.struct(at.alias("date"), "air_temperature", "track_temperature", "rainfall"))
            ).alias("weather")
        )
        messages = self.race_control.groupBy("session_key", part).agg(
            F.sort_array(F.collect_list(F.struct(at.alias("date"), "flag", "message", "lap_number"))).alias("race_control")
        )
        per_session = readings.join(messages, ["session_key", "_part"], "full").select(
            "session_key", F.lit(2024).alias("year"), "weather", "race_control"
        )
        return per_driver.unionByName(per_session, allowMissingColumns=True)

    @cached_property
    def sessions(self) -> DataFrame:
        key = c("session_key")
        return (
            self.feed.groupBy("session_key")
            .agg(F.min("event_time").alias("date_start"))
            .select(
                "session_key",
                F.when(key % 5 == 0, "Race")
                .when(key % 5 == 1, "Qualifying")
                .when(key % 5 == 2, "Sprint")
                .otherwise("Practice")
                .alias("session_type"),
                "date_start",
                F.when(key % 4 == 0, "Japan")
                .when(key % 4 == 1, "Italy")
                .when(key % 4 == 2, "Nowhere")
                .otherwise("Monaco")
                .alias("country_name"),
            )
        )

    @cached_property
    def logs(self) -> DataFrame:
        k, text = c("k"), c("value").cast("string")
        ident, kt = c("event_id").cast("string"), c("k").cast("string")
        report = F.concat(
            F.lit("REPORT RequestId: r"),
            ident,
            F.lit(" Duration: "),
            text,
            F.lit(" ms  Billed Duration: "),
            F.ceil("value").cast("int").cast("string"),
            F.lit(" ms Memory Size: 512 MB Max Memory Used: "),
            (50 + k).cast("string"),
            F.lit(" MB"),
            F.when(k % 10 == 9, " Init Duration: 432.1 ms").otherwise(""),
        )
        return self.feed.select(
            "event_id",
            c("event_time").alias("ts"),
            F.concat(F.lit("fn-"), (c("driver_number") % 4).cast("string")).alias("function_name"),
            F.when(k % 10 == 0, F.concat(F.lit("START RequestId: r"), ident))
            .when(k % 10 == 1, F.concat(F.lit("[ERROR] failure "), kt))
            .when(k % 10 == 2, F.concat(F.lit('{"k": '), kt, F.lit("}")))
            .when(k % 10 == 3, F.concat(F.lit("ModelLatency:"), text))
            .otherwise(report)
            .alias("message"),
        )

    @cached_property
    def metric_points(self) -> DataFrame:
        kind = c("event_type")
        return self.feed.select(
            "event_id",
            c("event_time").alias("ts"),
            F.concat(F.lit("fn-"), (c("driver_number") % 4).cast("string")).alias("function_name"),
            F.when(kind == "view", "Duration")
            .when(kind == "click", "Invocations")
            .when(kind == "error", "Errors")
            .when(kind == "purchase", "ModelLatency")
            .otherwise("PredictionConfidence")
            .alias("metric_name"),
            F.when(kind == "signup", c("k") / 100.0).otherwise(c("value")).alias("metric_value"),
        )

    @cached_property
    def nested_predictions(self) -> DataFrame:
        """Predictions as the scoring step emits them: a feature array and a nested result.

        Every seventh probability is missing, and arrays have 3 to 11 values.
        """
        p = self.predictions
        values = F.array(
            c("tyre_age").cast("double"),
            c("stint_number").cast("double"),
            c("gap_to_leader"),
            (18.0 + c("throttle") % 22),
            (30.0 + c("throttle") % 30),
            F.when(c("throttle") % 12 == 0, 1.0).otherwise(0.0),
            c("speed"),
            F.lit(0.25),
            F.lit(0.5),
            F.lit(0.75),
            F.lit(1.0),
        )
        known = c("throttle") % 7 != 0
        probability = F.when(known, c("pitstop_probability"))
        return p.select(
            *DRIVER,
            "driver_name",
            "team",
            "tyre_compound",
            "lap_number",
            "ts",
            "pits_completed",
            F.when(c("pits_completed") > 0, c("speed")).alias("last_pit_duration"),
            F.when(c("pits_completed") > 0, c("lap_number") - c("tyre_age")).alias("last_pit_lap"),
            F.when(c("throttle") % 4 != 0, c("drs_active")).alias("drs_active"),
            "speed",
            "throttle",
            (100 - c("throttle")).alias("brake"),
            (c("throttle") % 9).alias("gear"),
            F.slice(values, F.lit(1), 3 + c("throttle") % 9).alias("features"),
            F.struct(
                probability.alias("pitstop_probability"), F.when(known, c("confidence")).alias("confidence")
            ).alias("prediction"),
            ((c("speed") % 100) / 100).alias("win_probability"),
            "safety_car_active",
            "commentary",
        )

    @cached_property
    def inference_log(self) -> DataFrame:
        """One document per session and lap: at most 22 predictions each, one per driver."""
        item = F.struct(
            "driver_number", "driver_name", "team", "tyre_compound", "lap_number", "pits_completed",
            "last_pit_duration", "last_pit_lap", "drs_active", "speed", "throttle", "brake", "gear", "features",
            "prediction", "win_probability", "safety_car_active",
        )
        country = c("session_key") % 4
        return (
            self.nested_predictions.groupBy("session_key", "lap_number")
            .agg(
                F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                F.sort_array(F.collect_list(item)).alias("predictions"),
                F.bool_or("safety_car_active").alias("safety_car_active"),
                F.max("commentary").alias("commentary"),
            )
            .select(
                "session_key",
                F.when(country == 0, "Japan").when(country == 1, "Italy").when(country == 2, "Nowhere").otherwise("Monaco").alias("country_name"),
                "timestamp",
                "predictions",
                "safety_car_active",
                F.lit(False).alias("race_finished"),
                "commentary",
            )
        )
