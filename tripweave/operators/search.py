"""Text search over the catalog as equi-joins on grams, tokens and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import params
from ..functions import geo, text
from ..session import spread


def grams(value: Column, most: int = 3) -> Column:
    """Distinct substrings of one to ``most`` characters."""
    n = F.length(value)

    def of_size(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
        return F.when(n >= size, F.transform(starts, lambda i: F.substring(value, i, F.lit(size))))

    parts = [of_size(size) for size in range(1, most + 1)]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*parts))))


def substring_pairs(queries: DataFrame, needle: str, names: DataFrame, text_column: str) -> DataFrame:
    """(query, name) rows where the name contains the needle.

    A name that contains the needle contains its first three letters, so the pair is
    found by an equi-join on that gram and checked afterwards.
    """
    left = queries.filter(F.length(needle) > 0).withColumn("_gram", F.substring(needle, 1, 3))
    right = names.withColumn("_gram", F.explode(grams(F.col(text_column))))
    return left.join(right, "_gram").filter(F.contains(F.col(text_column), F.col(needle))).drop("_gram")


def catalog_entries(categories: DataFrame, labels: DataFrame, brands: DataFrame, aliases: DataFrame, outlets: DataFrame, hubs: DataFrame) -> DataFrame:
    """What a catalog search can show: kind, display name, outlet count and its search keys."""
    from .catalog import category_catalog

    open_outlets = outlets.filter("closure_status <> 'closed'").join(hubs.filter("closure_status <> 'closed'").select("hub_id", "name"), "hub_id")
    heads = category_catalog(categories, outlets).join(labels, "slug").select(
        F.lit("category").alias("kind"), F.col("heading").alias("label"), "outlet_count", F.array(text.normalize("heading"), text.normalize("slug")).alias("keys")
    )
    known = aliases.groupBy(F.col("brand_slug").alias("slug")).agg(F.collect_set("alias").alias("names"))
    counts = open_outlets.filter("brand_idx IS NOT NULL").groupBy("brand_idx").agg(F.count("*").alias("outlet_count"))
    chains = brands.join(counts, "brand_idx").join(known, "slug", "left").select(
        F.lit("brand").alias("kind"), F.col("brand_name").alias("label"), "outlet_count",
        F.concat(F.array(F.lower("brand_name")), F.coalesce("names", F.array().cast("array<string>"))).alias("keys"),
    )
    places = open_outlets.filter("brand_idx IS NULL").groupBy("name").agg(F.count("*").alias("outlet_count")).select(
        F.lit("place").alias("kind"), F.col("name").alias("label"), "outlet_count", F.array(F.lower("name")).alias("keys")
    )
    return heads.unionByName(chains).unionByName(places)


def catalog_search(queries: DataFrame, entries: DataFrame, limit: int = 20) -> DataFrame:
    """Entries matching each query: categories first, then exact, commonest, name."""
    asked = queries.withColumn("needle", text.normalize("q"))
    keyed = entries.select("kind", "label", "outlet_count", F.explode(F.array_distinct("keys")).alias("key"))
    hits = substring_pairs(asked, "needle", keyed, "key").select("q", "needle", "kind", "label", "outlet_count").distinct()
    order = [
        F.when(F.col("kind") == "category", 0).otherwise(1),
        F.when(F.when(F.col("kind") == "category", text.normalize("label")).otherwise(F.lower("label")) == F.col("needle"), 0).otherwise(1),
        F.col("outlet_count").desc(), "label", "kind",
    ]
    place = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    return hits.withColumn("place", place).filter(F.col("place") <= limit).drop("needle")


def hub_search(queries: DataFrame, hubs: DataFrame, limit: int = 6) -> DataFrame:
    """Open hubs by substring, words in order, or compact text; exact compact first."""
    asked = queries.withColumn("needle", text.normalize("q")).filter("needle <> ''").withColumn("tight", F.replace("needle", F.lit(" "), F.lit("")))
    names = hubs.filter("closure_status <> 'closed'").select("hub_id", "name", F.lower("name").alias("low"))
    names = names.withColumn("close", F.regexp_replace("low", "[ @-]", ""))
    # Words in order need the first word's first letters, a compact hit the compact needle's. Names repeated for
    # their pieces are many times what their table's size tells, so they are never broadcast.
    by_word = asked.withColumn("_gram", F.substring(F.split("needle", " ")[0], 1, 3)).join(
        names.withColumn("_gram", F.explode(grams(F.col("low")))).hint("merge"), "_gram"
    )
    by_tight = asked.withColumn("_gram", F.substring("tight", 1, 3)).join(
        names.withColumn("_gram", F.explode(grams(F.col("close")))).hint("merge"), "_gram"
    )
    in_order = F.concat(F.lit("%"), F.replace("needle", F.lit(" "), F.lit("%")), F.lit("%"))
    hits = by_word.unionByName(by_tight).withColumn("_pattern", in_order).filter(
        F.expr("contains(low, needle) OR low LIKE _pattern OR contains(close, tight)")
    ).select("q", "hub_id", "name", (F.col("close") == F.col("tight")).alias("exact")).distinct()
    order = [F.when(F.col("exact"), 0).otherwise(1), "name", "hub_id"]
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("place") <= limit)


def distinct_labels(results: DataFrame) -> DataFrame:
    """First result of each (kind, folded label) per query."""
    best = F.min(F.struct("place", "label")).alias("b")
    return results.groupBy("q", "kind", F.lower(text.safe_label("label", "Independent place")).alias("folded")).agg(best).select("q", "kind", F.col("b.label").alias("label"))


def brand_keys(brands: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every normalised name of a brand."""
    own = brands.select("slug", "brand_name", F.explode(F.array(text.normalize("brand_name"), text.normalize("slug"))).alias("key"))
    other = aliases.join(brands, aliases.brand_slug == brands.slug).select("slug", brands.brand_name, F.col("alias").alias("key"))
    return own.union(other).distinct()


# --- postings -------------------------------------------------------------------


def search_documents(outlets: DataFrame, hubs: DataFrame, brands: DataFrame, aliases: DataFrame, categories: DataFrame) -> DataFrame:
    """One search text per open outlet; fields are kept apart so a phrase cannot span two."""
    names = aliases.groupBy(F.col("brand_slug").alias("slug")).agg(F.array_join(F.array_sort(F.collect_set("alias")), " | ").alias("alias_text"))
    dim = brands.join(names, "slug", "left").select("brand_idx", "brand_name", "alias_text")
    rows = (
        outlets.filter("closure_status <> 'closed'")
        .join(hubs.filter("closure_status <> 'closed'").select("hub_id", "name", "address", "lat", "lon", "source"), "hub_id")
        .join(dim, "brand_idx", "left")
        .join(categories.select("category_idx", F.col("slug").alias("category")), "category_idx")
    )
    fields = [text.normalize(F.coalesce(c, F.lit(""))) for c in ("brand_name", "category", "name", "address")]
    return rows.withColumn("label", F.coalesce("brand_name", "name")).withColumn(
        "doc", F.concat_ws(" | ", *fields, F.coalesce("alias_text", F.lit("")))
    )


def postings(documents: DataFrame) -> DataFrame:
    return documents.select("outlet_id", F.explode(F.array_distinct(F.filter(F.split(F.regexp_replace("doc", r"\|", " "), " +"), lambda t: t != ""))).alias("token"))


def phrase_hits(phrases: DataFrame, documents: DataFrame, posting_rows: DataFrame) -> DataFrame:
    """Documents holding each phrase (column ``phrase``, normalised).

    The phrase enters the postings by its rarest token, so a word a third of the catalog
    shares never drives the join while a rarer one is there; the phrase is then rechecked.
    """
    frequency = posting_rows.groupBy("token").agg(F.count("*").alias("n"))
    words = phrases.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("token")).distinct()
    rarest = words.join(frequency, "token", "left").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("w")
    ).filter("w.n > 0").select("phrase", F.col("w.token").alias("token"))
    return rarest.join(posting_rows, "token").join(documents, "outlet_id").filter(
        F.contains(F.concat(F.lit(" "), F.col("doc"), F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    ).drop("token")


def discovery(needs: DataFrame, documents: DataFrame, posting_rows: DataFrame) -> DataFrame:
    """Outlets that hold any of the terms of a need, with the terms they show.

    needs: norm, category_hint, terms (normalised, most telling first). A term matches the
    search text as a phrase; ``evidence`` lists, in their order, the terms that also stand in
    what a traveller reads of the outlet. Aliases are matched but not read. A hint limits the
    outlets to its category, and joins on it, so a term as common as "food" meets that category only.
    """
    asked = needs.select("norm", "category_hint", "terms").distinct()
    words = asked.select("norm", "category_hint", "terms", F.explode("terms").alias("phrase"))
    hits = phrase_hits(words.select("phrase").distinct(), documents, posting_rows)
    hinted = words.filter("category_hint IS NOT NULL").join(hits.withColumn("category_hint", F.col("category")), ["phrase", "category_hint"])
    free = words.filter("category_hint IS NULL").join(hits, "phrase")
    found = hinted.unionByName(free).drop("phrase").dropDuplicates(["norm", "category_hint", "outlet_id"])
    shown = F.lower(F.concat_ws(" | ", "label", "brand_name", "name", "address", "source", "category"))
    rows = found.withColumn("shown", shown).withColumn("evidence", F.filter("terms", lambda t: F.contains(F.col("shown"), t)))
    return rows.withColumn("evidence_exact", F.contains("shown", F.col("terms")[0])).drop("shown")


def discovery_order(found: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` outlets of a need by name, those that show its first term ahead, then more evidence."""
    need = ["norm", "category_hint"]
    named = F.row_number().over(Window.partitionBy(*need).orderBy("label", "outlet_id"))
    rows = found.withColumn("n", named).filter(F.col("n") <= max(1, min(limit, 50))).drop("n")
    order = [F.when(F.col("evidence_exact"), 0).otherwise(1), -F.size("evidence"), F.lower("label"), "outlet_id"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*need).orderBy(*order)))


def need_places(needs: DataFrame, documents: DataFrame, posting_rows: DataFrame) -> DataFrame:
    """Places for open needs with tier, suitability and relevance.

    needs: norm, need_type, category_hint, terms, place_type. A place is direct if its name,
    evidence or category holds a term that says more than the category, the kind of place or,
    of a dish, the word for all dishes. Dishes, named businesses and unknown needs take direct
    places only; others take the rest of the category as supported.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    dish = F.col("need_type") == "dish"
    generic = F.when(dish, F.try_element_at("terms", F.lit(2)))
    broad = F.array_compact(F.array(bare(F.coalesce("category_hint", F.lit(""))), bare(F.col("place_type")), bare(generic)))
    source = F.when(dish, F.slice("terms", 1, 2)).otherwise(F.col("terms"))
    kinds = needs.select("norm", "need_type", "category_hint", "terms", "place_type").distinct().withColumn("broad", broad)
    kinds = kinds.withColumn("direct_terms", F.filter(source, lambda t: (F.length(bare(t)) >= 3) & ~F.array_contains(F.col("broad"), bare(t))))
    found = discovery(kinds, documents, posting_rows).withColumn("hint", F.coalesce("category_hint", F.lit(""))).drop("terms", "category_hint")
    kinds = kinds.withColumn("hint", F.coalesce("category_hint", F.lit(""))).select("norm", "hint", "need_type", "direct_terms")
    rows = found.join(kinds, ["norm", "hint"])
    read = text.normalize(F.concat_ws(" ", "label", F.concat_ws(" ", "evidence"), "category"))
    rows = rows.withColumn("read", read).withColumn("direct", F.exists("direct_terms", lambda t: text.contains_phrase(F.col("read"), t)))
    rows = rows.filter(F.col("direct") | F.col("need_type").isin("product", "service"))
    return rows.select(
        "norm", "need_type", "outlet_id", F.when(F.col("direct"), "strong").otherwise("supported").alias("tier"),
        F.when(F.col("need_type") == "dish", "business_verified").otherwise("category_likely").alias("suitability"),
        F.when(F.col("direct"), 1.0).otherwise(0.7).alias("relevance"),
    )


# --- fuzzy ----------------------------------------------------------------------


def similar_pairs(queries: DataFrame, query: str, names: DataFrame, name: str, least: float) -> DataFrame:
    """Pairs whose edit-distance ratio is at least ``least``, exactly.

    With at most e edits allowed, one of e + 1 pieces of the query survives in the name
    unchanged, so candidates come from an equi-join of pieces with substrings. Lengths too
    far apart for the ratio never meet. Queries are few bytes that meet many names, so they are spread.
    """
    n = F.length(query)
    edits = F.floor(n * (1 - least) / least + 1e-9)
    pieces = F.least(edits + 1, n)
    size = F.floor(n / pieces).cast("int")
    cut = F.transform(F.sequence(F.lit(0), (pieces - 1).cast("int")), lambda i: F.substring(F.col(query), i * size + 1, size))
    left = spread(queries.filter(F.length(query) > 0).distinct(), query).withColumn("_piece", F.explode(F.array_distinct(cut)))
    m = F.length(name)
    every = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), m),
                lambda i: F.transform(F.sequence(F.lit(1), m - i + 1), lambda k: F.substring(F.col(name), i, k)),
            )
        )
    )
    right = names.filter(F.length(name) > 0).distinct().withColumn("_piece", F.explode(every))
    close = F.least(n, m) + 1e-9 >= least * F.greatest(n, m)
    pairs = left.join(right, "_piece").filter(close).drop("_piece").distinct()
    return pairs.withColumn("similarity", text.similarity(query, name)).filter(F.col("similarity") >= least)


def station_aliases(stations: DataFrame) -> DataFrame:
    """Alias keys of every station: names with and without its kind, and its codes."""
    code = F.concat("line", F.col("ordinal").cast("string"))
    spaced = F.concat("line", F.lit(" "), F.col("ordinal").cast("string"))
    forms = F.array("name", F.concat("name", F.lit(" MRT")), F.concat("name", F.lit(" station")), F.concat("name", F.lit(" MRT station")), code, spaced)
    rows = stations.select("station_id", "name", "lat", "lon", F.explode(forms).alias("alias"))
    keys = F.array_distinct(F.array(text.normalize("alias"), text.compact("alias")))
    return rows.withColumn("key", F.explode(keys))


def exact_stations(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    keys = F.array_distinct(F.array(text.normalize("q"), text.compact("q")))
    hits = queries.select("q", F.explode(keys).alias("key")).join(aliases.select("key", "station_id", "name"), "key").select("q", "station_id", "name").distinct()
    n = F.count("*").over(Window.partitionBy("q"))
    return hits.withColumn("confidence", F.when(n == 1, "exact").otherwise("ambiguous"))


def fuzzy_stations(queries: DataFrame, aliases: DataFrame, least: float = params.STATION_MATCH) -> DataFrame:
    """Station whose best alias is similar enough, digits agreeing; ambiguous within the margin."""
    asked = queries.select("q", text.compact("q").alias("tight")).filter("tight <> ''")
    names = aliases.select("station_id", "name", text.compact("alias").alias("alias_key")).distinct()
    pairs = similar_pairs(asked, "tight", names, "alias_key", least)
    best = pairs.groupBy("q", "tight", "station_id", "name").agg(F.max(F.struct("similarity", "alias_key")).alias("b"))
    digits = F.regexp_replace("tight", "[^0-9]", "")
    best = best.filter((digits == "") | F.contains(F.col("b.alias_key"), digits)).select("q", "station_id", "name", F.col("b.similarity").alias("similarity"))
    per = Window.partitionBy("q").orderBy(F.col("similarity").desc(), "name", "station_id")
    ranked = best.withColumn("place", F.row_number().over(per)).withColumn("runner_up", F.lead("similarity").over(per))
    ranked = ranked.withColumn("clear", F.first(F.col("runner_up").isNull() | (F.col("similarity") - F.col("runner_up") >= params.STATION_MARGIN - 1e-9)).over(per))
    return ranked.filter("NOT clear OR place = 1").withColumn("confidence", F.when(F.col("clear"), "strong").otherwise("ambiguous"))


def suggestions(queries: DataFrame, aliases: DataFrame, limit: int = 3) -> DataFrame:
    """Up to three station names near a query that matched nothing."""
    asked = queries.select("q", text.compact("q").alias("tight")).filter(F.length("tight") >= 3)
    names = aliases.select("name", text.compact("alias").alias("alias_key")).distinct()
    pairs = similar_pairs(asked, "tight", names, "alias_key", params.STATION_SUGGEST)
    best = pairs.groupBy("q", "name").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("similarity").desc(), F.col("name").desc()))
    return best.withColumn("place", place).filter(F.col("place") <= limit)


def location_cascade(queries: DataFrame, aliases: DataFrame, hubs: DataFrame) -> DataFrame:
    """First source that knows a query: exact station, similar station, hub of the catalog."""
    exact = exact_stations(queries, aliases)
    left = queries.join(exact.select("q").distinct(), "q", "left_anti")
    similar = fuzzy_stations(left, aliases)
    left = left.join(similar.select("q").distinct(), "q", "left_anti")
    found = hub_search(queries, hubs)
    # A bare station name that also names a hub is ambiguous; both are shown.
    twins = found.filter("exact").join(
        exact.filter(text.compact("q") == text.compact("name")).select("q").distinct(), "q", "left_semi"
    )
    n = F.count("*").over(Window.partitionBy("q"))
    top = F.max(F.when(F.col("place") == 1, F.col("exact"))).over(Window.partitionBy("q"))
    local = found.join(left, "q", "left_semi").withColumn(
        "confidence", F.when(top, "exact").when(n == 1, "likely").otherwise("ambiguous")
    )
    clash = twins.select("q").distinct().withColumn("clash", F.lit(True))
    stations = exact.join(clash, "q", "left").select("q", F.lit("station").alias("source"), F.col("station_id").cast("bigint").alias("entity"), F.when(F.col("clash"), "ambiguous").otherwise(F.col("confidence")).alias("confidence"))
    return (
        stations.unionByName(twins.select("q", F.lit("hub").alias("source"), F.col("hub_id").alias("entity"), F.lit("ambiguous").alias("confidence")))
        .unionByName(similar.select("q", F.lit("similar").alias("source"), F.col("station_id").cast("bigint").alias("entity"), "confidence"))
        .unionByName(local.select("q", F.lit("hub").alias("source"), F.col("hub_id").alias("entity"), "confidence"))
    )


def postal(queries: DataFrame, hubs: DataFrame) -> DataFrame:
    """Six-digit codes to the building that has it, else the centre of its sector."""
    coded = hubs.withColumn("code", F.regexp_extract("address", "Singapore ([0-9]{6})$", 1)).filter("code <> ''")
    exact = coded.groupBy("code").agg(F.min_by(F.struct("lat", "lon"), "hub_id").alias("at"))
    sector = coded.groupBy(F.substring("code", 1, 2).alias("sector")).agg(F.avg("lat").alias("s_lat"), F.avg("lon").alias("s_lon"))
    rows = queries.withColumn("sector", F.substring("code", 1, 2)).join(exact, "code", "left").join(sector, "sector", "left")
    return rows.filter("at IS NOT NULL OR s_lat IS NOT NULL").select(
        "code", F.round(F.coalesce("at.lat", "s_lat"), 6).alias("lat"), F.round(F.coalesce("at.lon", "s_lon"), 6).alias("lon"), F.col("at").isNull().alias("approximate")
    )


# Words that tell a discovered place's category, first rule wins.
PLACE_WORDS = (
    (("bubble tea", "milk tea", "tea shop"), "bubble_tea"), (("cafe", "coffee"), "coffee"), (("restaurant", "food"), "restaurants"),
    (("pharmacy", "chemist"), "pharmacy"), (("electronics", "mobile phone", "computer"), "electronics"),
    (("hair salon", "barber", "hairdresser"), "haircuts"), (("florist", "flower"), "florists"), (("pet shop", "pet store"), "pet_supplies"),
)


def place_category(value: str) -> Column:
    label = F.lit(None).cast("string")
    for words, category in reversed(PLACE_WORDS):
        test = F.lit(False)
        for word in words:
            test = test | F.contains(F.col(value), F.lit(word))
        label = F.when(test, category).otherwise(label)
    return label


def grounded(leads: DataFrame, hubs: DataFrame) -> DataFrame:
    """Catalog places named in a text, unless its location hint disagrees with their address.

    Equal texts name the same places, so each text meets the catalog once and hands its places on.
    """
    places = hubs.filter("closure_status <> 'closed'").select("hub_id", text.normalize("name").alias("name_key"), text.normalize(F.coalesce("address", F.lit(""))).alias("where")).filter("name_key <> ''")
    size = F.size(F.split("name_key", " "))
    bounds = places.agg(F.min(size).alias("low"), F.max(size).alias("high")).first()
    low, high = bounds["low"] or 1, bounds["high"] or 1
    words = F.split(text.normalize("text"), " ")
    n = F.size(words)
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.when(i + k - 1 <= n, F.array_join(F.slice(words, i, k), " "))),
        )
    )
    rows = spread(leads.select("text").distinct(), "text").withColumn("name_key", F.explode(F.array_distinct(F.array_compact(spans))))
    hint = text.normalize(F.regexp_extract("text", r"\bat ([A-Z][A-Za-z]+(?: [A-Z][a-z]+)?)", 1))
    named = rows.withColumn("hint", hint).join(places, "name_key").filter((F.col("hint") == "") | text.contains_phrase("where", "hint"))
    return leads.join(named, "text")


def location_hints(value: str) -> Column:
    """Street addresses and "at/in X" phrases of a text, at most two."""
    street = r"\b[0-9]{1,4}[A-Za-z]?\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}\s+(?:Road|Rd|Street|St|Avenue|Ave|Drive|Dr|Lane|Way)\b"
    named = r"\b(?:at|in)\s+([A-Z][A-Za-z0-9@'&.-]+(?:\s+[A-Z][A-Za-z0-9@'&.-]+){0,2}?)(?=\s+(?:in|at|on|with|and|where|Singapore|store|outlet)\b|\s*[,.–—-])"
    first = F.slice(F.expr(f"regexp_extract_all({value}, r\"{street}\", 0)"), 1, 1)
    others = F.filter(
        F.transform(F.expr(f"regexp_extract_all({value}, r\"{named}\", 1)"), lambda h: F.trim(h)),
        lambda h: (F.size(F.split(text.normalize(h), " ")) >= 2) & ~text.normalize(h).isin("singapore", "southeast asia"),
    )
    return F.slice(F.array_distinct(F.concat(first, others)), 1, 2)
