"""The trip planner: trips and a catalog in, recommendations out.

Every stage is a table keyed by search or trip. Stages that several others read are
written once to the shared folder, so a lost executor costs a re-read and not the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import params
from ..functions import geo
from ..operators import candidates, catalog, evaluate, network, rank, routes
from ..session import spread, store


class TripPlan:
    """Stages of planning over one set of tables.

    trips: trip_id, departure, o/d coordinates, category_1/2 (index), exact_brand_1/2,
    preferred_category/brand, limits with hard flags, tolerances, urgency,
    prefer_consolidated, arrive_by. hubs, outlets, nodes, stations, categories as bound.

    ``route_table`` holds prices (minutes, walk_minutes, walk_m, transfers) per from_place, to_place and
    departure bucket of ``bucket_minutes``; each leg takes the row as of the moment it leaves, and
    legs that the table does not hold are priced from the network.
    """

    def __init__(self, spark, trips, hubs, outlets, nodes, stations, categories, with_fallbacks=True, route_table=None, bucket_minutes=1):
        self.spark, self.trips, self.hubs, self.outlets = spark, trips, hubs, outlets
        self.nodes, self.stations, self.categories = nodes, stations, categories
        self.with_fallbacks = with_fallbacks
        self.route_table, self.bucket_minutes = route_table, bucket_minutes
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, build, keep: bool = False) -> DataFrame:
        if name not in self._made:
            frame = build()
            self._made[name] = store(frame, name) if keep else frame
        return self._made[name]

    # --- network
    def edges(self):
        return self._once("edges", lambda: network.rail_edges(self.stations), keep=True)

    def matrix(self):
        return self._once("matrix", lambda: network.station_matrix(self.stations, self.edges()))

    def rides(self):
        return self._once("rides", lambda: network.rides(self.matrix(), self.edges(), self.stations), keep=True)

    def plans(self):
        return self._once("plans", lambda: network.pair_plans(self.matrix(), self.rides(), self.stations), keep=True)

    # --- catalog
    def closure(self):
        return self._once("closure", lambda: candidates.category_closure(self.categories), keep=True)

    def substitutes(self):
        def build():
            rows = [(params.CATEGORY_INDEX[a], params.CATEGORY_INDEX[b]) for a, b in params.SUBSTITUTES]
            return params.small_table(self.spark, rows, "category, substitute")

        return self._once("substitutes", build)

    def facts(self):
        return self._once("facts", lambda: candidates.hub_facts(self.hubs, self.outlets, self.nodes), keep=True)

    def hub_rows(self):
        return self._once("hub_rows", lambda: candidates.hub_category_rows(self.facts()))

    def brands(self):
        return self._once("brands", lambda: candidates.hub_brands(self.outlets))

    def quality(self):
        return self._once("quality", lambda: catalog.hub_quality(self.hubs, self.outlets, self.facts(), self.nodes))

    # --- routes
    def choices(self):
        def build():
            ends = self.trips.select(F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon")).union(
                self.trips.select("d_lat", "d_lon")
            ).union(self.facts().select("lat", "lon"))
            return network.place_stations(ends, self.stations)

        return self._once("choices", build, keep=True)

    def price(self, pairs: DataFrame) -> DataFrame:
        return network.price(spread(pairs, "from_place", "to_place"), self.choices(), self.plans())

    def routes(self):
        """Each trip with its direct trip: price, station pair and the ends of the line."""

        def build():
            keyed = self.trips.select(
                "trip_id", *candidates.ROUTE_FIELDS, geo.place_key("o_lat", "o_lon").alias("from_place"),
                geo.place_key("d_lat", "d_lon").alias("to_place"),
            )
            priced = self.price(keyed.select("from_place", "to_place").distinct()).drop("from_lat", "from_lon", "to_lat", "to_lon", "first_station", "last_station")
            whole = keyed.join(priced, ["from_place", "to_place"])
            if self.route_table is not None:
                whole = self.direct_as_of(whole)
            spots = self.plans().select("s", "t", "f_lat", "f_lon", "l_lat", "l_lon")
            return whole.join(spots, ["s", "t"], "left").select(
                "trip_id", *candidates.ROUTE_FIELDS, "s", "t", "walk_only", "f_lat", "f_lon", "l_lat", "l_lon",
                geo.haversine_km("o_lat", "o_lon", "d_lat", "d_lon").alias("base_km"),
                F.col("minutes").alias("base_minutes"), F.col("walk_minutes").alias("base_walk_minutes"),
                F.col("walk_m").alias("base_walk_m"), F.col("transfers").alias("base_transfers"),
            )

        return self._once("routes", build, keep=True)

    def direct_as_of(self, priced: DataFrame) -> DataFrame:
        """Direct trips with the table's price as of their departure, where it has one."""
        leaving = self.trips.select("trip_id", routes.bucket(F.col("departure"), self.bucket_minutes).alias("bucket"))
        rows = priced.join(leaving, "trip_id")
        found = routes.as_of(rows, self.route_table, self.bucket_minutes).withColumnsRenamed({c: f"t_{c}" for c in routes.PRICE})
        rows = rows.join(found, [*routes.PAIR, "bucket"], "left")
        return rows.withColumns({c: F.coalesce(f"t_{c}", c) for c in routes.PRICE}).drop("bucket", *[f"t_{c}" for c in routes.PRICE])

    def lines(self):
        return self.plans().select("s", "t", "line")

    # --- candidates
    def searches(self):
        def build():
            rows = candidates.searches(self.trips, self.substitutes() if self.with_fallbacks else None)
            ends = self.routes().drop("base_minutes", "base_walk_minutes", "base_walk_m", "base_transfers")
            return spread(candidates.with_route(rows, ends), "sid")

        return self._once("searches", build, keep=True)

    def line_hubs(self):
        def build():
            return candidates.rail_line_hubs(self.plans(), self.facts().select("hub_id", "lat", "lon"))

        return self._once("line_hubs", build, keep=True)

    def near_lists(self):
        return self._once("near_lists", lambda: candidates.near_lists(self.searches(), self.hub_rows(), self.line_hubs(), self.closure()))

    def lists(self, cut=False):
        """The corridor lists that the short list is made of; with ``cut``, that the kept options are made of."""

        def build():
            return candidates.corridor_lists(self.searches(), self.hub_rows(), self.plans(), self.closure(), cut)

        return self._once("best_lists" if cut else "lists", build, keep=True)

    def corridor_near(self):
        """Corridor hubs with transit access, of every search whose corridor holds any hub; the plan reads ``lists``.

        Of the lists only these rows are written, fewer than half of them: the filter leaves no
        search without a row, so which corridors are empty can be told from them.
        """

        def build():
            both = candidates.full_cover(self.searches(), self.hub_rows(), self.line_hubs())
            return candidates.transit_access(self.near_lists().unionByName(both))

        return self._once("corridor_near", build, keep=True)

    def far_rows(self):
        """Hubs of the whole catalog for searches whose corridor is empty."""
        return self._once(
            "far_rows",
            lambda: candidates.corridor_fallback(self.searches(), self.lists(cut=True), self.hub_rows(), self.closure(), self.lines()),
            keep=True,
        )

    def corridor_rows(self):
        """Corridor hubs with transit access; the whole category where the corridor is empty."""
        return self._once("corridor_rows", lambda: self.corridor_near().unionByName(candidates.transit_access(self.far_rows())))

    def rescued(self):
        return self._once(
            "rescued",
            lambda: candidates.coverage_rescue(self.searches(), candidates.served(self.lists(cut=True), self.far_rows()), self.hub_rows(), self.lines()),
            keep=True,
        )

    def shortlist(self, cut=False):
        """Hubs that options are made of; with ``cut``, those of options that can be kept."""

        def build():
            rows = candidates.shortlisted(self.lists(cut), self.far_rows(), self.rescued())
            return candidates.complete(rows, self.searches(), self.brands())

        return self._once("best_shortlist" if cut else "shortlist", build, keep=True)

    def pruned_first(self):
        return self._once("pruned_first", lambda: candidates.prune(candidates.options(self.shortlist(cut=True), cut=True)), keep=True)

    def exact_shortlist(self):
        def build():
            rows = candidates.exact_fallback(
                self.searches(), self.pruned_first(), self.hub_rows(), self.brands(), self.lines()
            )
            return candidates.complete(rows, self.searches(), self.brands())

        return self._once("exact_shortlist", build, keep=True)

    def areas(self):
        near = F.when(F.col("node_m") <= params.TRANSIT_M, F.col("nearest_node"))
        return self.facts().select("hub_id", "semantic_type", F.lit(None).cast("string").alias("group_id"), near.alias("area_id"))

    def pruned(self):
        return self._once(
            "pruned",
            lambda: candidates.relationship(
                self.pruned_first().unionByName(candidates.prune(candidates.options(self.exact_shortlist(), cut=True))), self.areas()
            ),
            keep=True,
        )

    def admitted(self):
        return self._once("admitted", lambda: candidates.admit(self.pruned()))

    # --- evaluation
    def orders(self):
        def build():
            rows = evaluate.with_dwell(self.admitted(), self.categories)
            rows = evaluate.preferred_met(rows, self.trips, self.brands())
            rows = evaluate.option_quality(rows, self.quality())
            return evaluate.visit_orders(rows)

        return self._once("orders", build, keep=True)

    def segments(self):
        return self._once("segments", lambda: evaluate.segments(self.orders()))

    def route_keys(self):
        return self.segments().select("from_place", "to_place").distinct()

    def starts(self):
        """Departure and dwell of every visit order."""
        leaving = self.trips.select("trip_id", "departure")
        return self.orders().withColumn("s2", F.coalesce("stop2", F.lit(-1))).join(leaving, "trip_id").select(*routes.ORDER, "departure", "dwell_a", "dwell_b")

    def priced_segments(self):
        def build():
            legs = self.segments().join(self.price(self.route_keys()), ["from_place", "to_place"], "left")
            if self.route_table is None:
                return legs
            return routes.along_the_clock(legs, self.starts(), self.route_table, self.bucket_minutes)

        return self._once("priced_segments", build)

    def totals(self):
        def build():
            keys = ["sid", "stop1", "s2", "order_no"]
            sums = evaluate.combine(self.priced_segments(), keys)
            rows = self.orders().withColumn("s2", F.coalesce("stop2", F.lit(-1))).join(sums, keys).drop("s2")
            direct = self.routes().select("trip_id", "base_minutes", "base_walk_minutes", "base_walk_m", "base_transfers")
            return rows.join(direct, "trip_id")

        return self._once("totals", build)

    def scored(self):
        def build():
            wishes = evaluate.factors(self.trips, self.spark).select(
                "trip_id", "departure", "max_detour_minutes", "max_detour_is_hard", "max_walk_minutes", "max_walk_is_hard",
                "max_transfers", "max_transfers_is_hard", "prefer_consolidated", "arrive_by", "walking_factor",
                "transfer_factor", "detour_factor",
            )
            whole = self.totals().filter("n_priced = n_segments").join(wishes, "trip_id")
            return evaluate.score(whole)

        return self._once("scored", build, keep=True)

    # --- results
    def winners(self):
        return self._once("winners", lambda: rank.distinct_winners(rank.objectives(rank.winner_pool(self.scored()))))

    def recommended(self):
        return self._once(
            "recommended", lambda: self.winners().unionByName(rank.fill(self.winners(), self.scored(), self.categories)), keep=True
        )

    def considered(self):
        return self._once("considered", lambda: rank.considered(self.scored(), self.recommended()))

    def outcomes(self):
        return self._once("outcomes", lambda: rank.outcomes(self.trips, self.scored()))

    def result(self):
        """Recommendations, considered options and the outcome of every trip in one table."""
        fields = ["first_stop", "second_stop", "label", "score", "added_minutes", "added_walk_m", "added_transfers"]
        shown = self.recommended().select("trip_id", F.lit("recommended").alias("role"), F.col("result").alias("name"), F.col("slot").alias("place"), *fields)
        also = self.considered().select("trip_id", F.lit("considered").alias("role"), F.lit("compared").alias("name"), "place", *fields)
        return self.outcomes().join(shown.unionByName(also), "trip_id", "left")

    def funnel(self):
        """Per trip: what each stage of the main search let through."""
        main = self.searches().filter("search_no = 0")
        spread_out = candidates.expand_categories(main, self.closure())
        pairs = main.select("c1", "c2").distinct().withColumn("sid", F.monotonically_increasing_id())
        in_category = candidates.once_per_hub(candidates.expand_categories(pairs, self.closure()).join(self.hub_rows(), "category"))
        per_pair = in_category.groupBy("c1", "c2").agg(F.count("*").alias("category_hubs"))
        met = candidates.flags(candidates.once_per_hub(candidates.near_route(spread_out, self.hub_rows(), self.line_hubs(), ["category"])))
        near = met.filter("inside").groupBy("sid", "hub_id").agg(F.bool_or("transit").alias("transit"))
        far = self.far_rows().filter("sid % 8 = 0")
        near = near.unionByName(far.groupBy("sid", "hub_id").agg(F.bool_or("transit").alias("transit")))
        corridor = near.groupBy("sid").agg(F.count("*").alias("corridor_hubs"), F.count_if("transit").alias("n"))
        extra = self.rescued().select("sid", "hub_id").distinct().groupBy("sid").agg(F.count("*").alias("extra"))
        counted = candidates.option_counts(self.shortlist()).unionByName(
            candidates.option_counts(self.exact_shortlist().join(candidates.option_counts(self.shortlist()).filter("n_options > 0").select("sid"), "sid", "left_anti"))
        ).groupBy("sid").agg(F.max("n_options").alias("options"))
        left = [self.pruned().groupBy("sid").agg(F.count("*").alias("pruned")), self.admitted().groupBy("sid").agg(F.count("*").alias("admitted"))]
        done = self.scored().groupBy("sid").agg(F.count("*").alias("evaluated"), F.count_if("excessive").alias("over_detour_cap"))
        lost = self.totals().filter("n_priced < n_segments").groupBy("sid").agg(F.count("*").alias("unpriced"))
        rows = main.select("trip_id", "sid", "c1", "c2")
        rows = rows.join(per_pair, (rows.c1 == per_pair.c1) & rows.c2.eqNullSafe(per_pair.c2), "left").drop("c1", "c2")
        for part in (corridor, extra, counted, *left, done, lost):
            rows = rows.join(part, "sid", "left")
        rows = rows.fillna(0)
        transit = F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("corridor_hubs")) + F.col("extra")
        return rows.select("trip_id", "category_hubs", "corridor_hubs", transit.alias("transit_hubs"), "options", "pruned", "admitted", "evaluated", "unpriced", "over_detour_cap")

    def call_summary(self):
        """Routing work over all trips: distinct pairs priced per trip and how many were shared."""
        asked = self.segments().join(self.orders().select("sid", "trip_id").distinct(), "sid").select("trip_id", "from_place", "to_place")
        direct = self.routes().select("trip_id", geo.place_key("o_lat", "o_lon").alias("from_place"), geo.place_key("d_lat", "d_lon").alias("to_place"))
        each = asked.unionByName(direct).groupBy("trip_id", "from_place", "to_place").agg(F.count("*").alias("n"))
        per = each.groupBy("trip_id").agg(F.count("*").alias("calls"), F.sum("n").alias("asked"))
        found = self.winners().select("trip_id").distinct().withColumn("found", F.lit(1))
        return per.join(found, "trip_id", "left").agg(
            F.count("*").alias("case_count"), F.round(F.avg("calls"), 2).alias("average_route_calls"), F.max("calls").alias("worst_route_calls"),
            F.round(1 - F.sum("calls") / F.sum("asked"), 4).alias("cache_hit_rate"), F.count_if(F.col("calls") > params.SOFT_BUDGET).alias("over_soft_budget"),
            F.count_if(F.col("calls") > params.HARD_BUDGET).alias("over_hard_budget"), F.count_if(F.col("found").isNull()).alias("without_result"),
        )
