"""Addresses to districts by street and house number, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T


def district_streets(ranges: DataFrame, districts: DataFrame) -> DataFrame:
    """(municipality_id, district_id, street_norm), distinct."""
    keyed = ranges.join(districts.select("district_id", "municipality_id"), "district_id")
    return keyed.select("municipality_id", "district_id", T.norm_street("street").alias("street_norm")).filter("street_norm <> ''").distinct()


def assign_by_street(addresses: DataFrame, streets: DataFrame) -> DataFrame:
    """Each address with every district of its street, null where there is none. Both sides carry municipality_id, as street names repeat in every town."""
    return addresses.join(streets, (addresses["municipality_id"] == streets["municipality_id"]) & (addresses["ulica_norm"] == streets["street_norm"]), "left").select(addresses["*"], "district_id")


def assignment_totals(clean: DataFrame, streets: DataFrame) -> DataFrame:
    """(municipality_id, total, assigned, unassigned); counted per street before the join."""
    per = clean.groupBy("municipality_id", F.col("ulica_norm").alias("street_norm")).agg(F.count("*").alias("n"))
    known = streets.select("municipality_id", "street_norm").distinct().withColumn("known", F.lit(True))
    has = F.coalesce("known", F.lit(False))
    return per.join(known, ["municipality_id", "street_norm"], "left").groupBy("municipality_id").agg(
        F.sum("n").alias("total"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("assigned"), F.sum(F.when(~has, F.col("n")).otherwise(0)).alias("unassigned")
    )


def coverage_gaps(clean: DataFrame, streets: DataFrame) -> DataFrame:
    """(municipality_id, street_norm, sample, addresses): streets with addresses in no district."""
    per = clean.groupBy("municipality_id", F.col("ulica_norm").alias("street_norm")).agg(F.min("ulica").alias("sample"), F.count("*").alias("addresses"))
    return per.join(streets, ["municipality_id", "street_norm"], "left_anti")


def empty_streets(clean: DataFrame, streets: DataFrame) -> DataFrame:
    """District streets without any address."""
    return streets.join(clean.select("municipality_id", F.col("ulica_norm").alias("street_norm")), ["municipality_id", "street_norm"], "left_anti")


def border_streets(streets: DataFrame) -> DataFrame:
    """(municipality_id, street_norm, districts): streets of more than one district."""
    return streets.groupBy("municipality_id", "street_norm").agg(F.count_distinct("district_id").alias("districts")).filter("districts > 1")


def district_address_stats(register: DataFrame, clean: DataFrame, streets: DataFrame, mismatches: DataFrame | None = None) -> DataFrame:
    """Addresses, streets and street coverage of each district, in the register and in its clean form.

    Both are counted per municipality and street before they meet the districts' streets, so the join has one row per
    district and street. Coverage is rounded half up to four places by whole-number arithmetic.
    """
    raw = register.filter("obyvatelna = true").select("municipality_id", T.norm_street("ulica").alias("street_norm"), "register_id", "ulica")
    raw = raw.groupBy("municipality_id", "street_norm").agg(F.count_distinct("register_id").alias("raw_n"), F.collect_set("ulica").alias("spellings"))
    neat = clean.groupBy("municipality_id", F.col("ulica_norm").alias("street_norm")).agg(F.count("*").alias("clean_n"))
    keys = ["municipality_id", "street_norm"]
    joined = streets.join(raw, keys, "left").join(neat, keys, "left")
    spellings = joined.select("district_id", F.explode("spellings").alias("s")).groupBy("district_id").agg(F.count_distinct("s").alias("register_streets"))
    counts = joined.groupBy("district_id").agg(
        F.coalesce(F.sum("raw_n"), F.lit(0)).alias("habitable_addresses"), F.count("*").alias("vzn_streets"), F.count("raw_n").alias("vzn_streets_in_register"),
        F.coalesce(F.sum("clean_n"), F.lit(0)).alias("clean_habitable_addresses"), F.count("clean_n").alias("clean_distinct_streets"),
    )
    share = lambda a, b: F.floor((F.col(a) * 20000 + F.col(b)) / (2 * F.col(b))) / 10000
    out = counts.join(spellings, "district_id", "left").select(
        "district_id", "habitable_addresses", F.coalesce("register_streets", F.lit(0)).alias("register_streets"), "vzn_streets", "vzn_streets_in_register",
        share("vzn_streets_in_register", "vzn_streets").alias("street_coverage"), "clean_habitable_addresses", "clean_distinct_streets", share("clean_distinct_streets", "vzn_streets").alias("clean_street_coverage"),
    )
    if mismatches is not None:
        out = out.join(mismatch_counts(mismatches, "vzn_district_id").withColumnRenamed("vzn_district_id", "district_id"), "district_id", "left").withColumn("mismatch_count", F.coalesce("mismatch_count", F.lit(0)))
    return out


def mismatch_counts(mismatches: DataFrame, by: str) -> DataFrame:
    return mismatches.groupBy(by).agg(F.count("*").alias("mismatch_count"))


def range_segments(ranges: DataFrame) -> DataFrame:
    """(district_id, street_norm, parity, lo, hi) of ranges with lo and hi; parity 0, 1 or null for both; null bounds are open."""
    parity = F.when(F.col("range_type") == "odd", 1).when(F.col("range_type") == "even", 0)
    single = F.col("range_type") == "single"
    return ranges.select("district_id", T.norm_street("street").alias("street_norm"), parity.alias("parity"), "lo", F.when(single, F.col("lo")).otherwise(F.col("hi")).alias("hi"))


def assign_by_house(addresses: DataFrame, segments: DataFrame) -> DataFrame:
    """Addresses with each district whose range on the street holds the house number; an address without a readable number is accepted by every range of its street. Both carry municipality_id."""
    a = addresses.withColumn("house", T.house_int("orientacne_cislo"))
    on = (a["municipality_id"] == segments["municipality_id"]) & (a["ulica_norm"] == segments["street_norm"])
    inside = (F.coalesce(segments["lo"], F.lit(0)) <= a["house"]) & (a["house"] <= F.coalesce(segments["hi"], F.lit(1_000_000_000)))
    fits = a["house"].isNull() | (inside & (segments["parity"].isNull() | (a["house"] % 2 == segments["parity"])))
    return a.join(segments, on & fits).select(a["*"], "district_id").distinct()


def prefix_match(points: DataFrame, streets: DataFrame, most: int = 50) -> DataFrame:
    """Points of each street whose trimmed name, in lower case, begins with the street's or the other way round, ``most`` by id per street.

    Distinct names meet by equality with the beginnings of the other side's names; a name brings its ``most`` smallest
    ids, as no street can take others.
    """
    a = points.select("point_id", F.lower(F.trim("street")).alias("p"))
    b = streets.select("street_id", F.lower(F.trim("street")).alias("s"))
    first = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("point_id"))).filter(F.col("n") <= most).drop("n")
    begins = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.left(F.col(c), n)))
    names, wanted = a.select("p").distinct(), b.select("s").distinct()
    pairs = names.select("p", begins("p").alias("s")).join(wanted, "s").select("p", "s")
    pairs = pairs.unionByName(wanted.select("s", begins("s").alias("p")).filter(F.col("p") != F.col("s")).join(names, "p").select("p", "s"))
    met = first(pairs.join(first(a, "p"), "p").select("s", "point_id"), "s")
    return first(met.join(b, "s").select("street_id", "point_id"), "street_id")


def match_coverage(streets: DataFrame, lines: DataFrame) -> DataFrame:
    """(district_id, matched, fallback): district streets with and without a line of the same key (lines: name)."""
    known = lines.select(T.norm_street("name").alias("street_norm")).distinct().withColumn("known", F.lit(True))
    return streets.join(known, "street_norm", "left").groupBy("district_id").agg(F.count_if("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("fallback"))


def street_seeds_all(geocodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Street geocodes whose district takes the whole street."""
    return geocodes.join(ranges.filter("range_type = 'all'"), ["district_id", "street"], "left_semi")


def pending(work: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not in the cache."""
    return work.join(cache, keys, "left_anti")


def detected_ranges(ranges: DataFrame, houses: DataFrame) -> DataFrame:
    """(district_id, street, detected_min, detected_max) of valid numeric houses, for streets that a district does not take whole."""
    partial = ranges.filter("range_type <> 'all'").select("district_id", "street").distinct()
    numeric = houses.filter(F.col("valid") & F.col("house_number").rlike("^[0-9]+$")).withColumn("n", F.col("house_number").try_cast("int"))
    return numeric.join(partial, ["district_id", "street"], "left_semi").groupBy("district_id", "street").agg(F.min("n").alias("detected_min"), F.max("n").alias("detected_max"))


def validation_report(houses: DataFrame, *by: str) -> DataFrame:
    """(by, total, valid, invalid, min_valid, max_valid)."""
    n = F.when(F.col("valid"), F.col("house_number").try_cast("int"))
    return houses.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.min(n).alias("min_valid"), F.max(n).alias("max_valid"))


def reason_counts(houses: DataFrame) -> DataFrame:
    return houses.groupBy(F.coalesce("validation_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def geocode_totals(geocodes: DataFrame, cost_per_1000: float = 5.0) -> DataFrame:
    """(status, n, partial, cost)."""
    return geocodes.groupBy("status").agg(F.count("*").alias("n"), F.count_if("partial_match").alias("partial")).withColumn("cost", F.col("n") * cost_per_1000 / 1000)


def _houses(kind: Column, n: Column, odd: tuple[int, int], even: tuple[int, int]) -> Column:
    """The house numbers of a range of this type and these numbers."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(n) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(n, 2 * i).alias("lo"), F.get(n, 2 * i + 1).alias("hi")))
    stepped = F.flatten(F.transform(F.filter(pairs, lambda p: p["lo"] <= p["hi"]), lambda p: F.sequence(p["lo"], p["hi"], F.lit(2))))
    whole = F.when(kind == "odd", F.sequence(F.lit(odd[0]), F.lit(odd[1]), F.lit(2))).otherwise(F.sequence(F.lit(even[0]), F.lit(even[1]), F.lit(2)))
    # a walk over the numbers: a pair more than one apart is a range, else its first number stands alone
    empty = F.struct(F.array().cast("array<int>").alias("out"), F.lit(None).cast("int").alias("held"))
    step = lambda s, x: (
        F.when(s["held"].isNull(), F.struct(s["out"].alias("out"), x.alias("held")))
        .when(x - s["held"] > 1, F.struct(F.concat(s["out"], F.sequence(s["held"], x)).alias("out"), F.lit(None).cast("int").alias("held")))
        .otherwise(F.struct(F.concat(s["out"], F.array(s["held"])).alias("out"), x.alias("held")))
    )
    walked = F.aggregate(n, empty, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))
    return (
        F.when(kind == "all", F.array().cast("array<int>")).when(kind == "single", n)
        .when(kind.isin("odd", "even"), F.when(F.size(n) < 2, whole).otherwise(stepped)).otherwise(walked)
    )


def expand_ranges(ranges: DataFrame, odd: tuple[int, int] = (1, 199), even: tuple[int, int] = (2, 200)) -> DataFrame:
    """(district_id, street, house_number) of the ranges (range_type, numbers): none for 'all', the listed ones for 'single', every second one
    between pairs for 'odd' and 'even' (all of the default bounds with fewer than two numbers), and for 'range' each pair that is more than one apart, else the number itself."""
    houses = _houses(F.col("range_type"), F.col("numbers"), odd, even)
    return ranges.select("district_id", "street", F.explode(houses).alias("house_number")).distinct()


def house_worklist(ranges: DataFrame, done: DataFrame, cap: int, odd: tuple[int, int] = (1, 199), even: tuple[int, int] = (2, 200)) -> DataFrame:
    """``expand_ranges`` sampled evenly to ``cap`` house numbers a street, without those in ``done`` (district_id, street, house_number).

    Only ranges and what is done are shuffled, once, by the street; its house numbers, a street's worth, come into being after that.
    """
    keys = ["district_id", "street"]
    held = ranges.groupBy(*keys).agg(F.collect_set(F.struct("range_type", "numbers")).alias("rs"))
    none = F.array().cast("array<int>")
    numbers = F.sort_array(F.array_distinct(F.flatten(F.transform("rs", lambda r: F.coalesce(_houses(r["range_type"], r["numbers"], odd, even), none)))))
    # a street's row at a time, so that the numbers are computed once
    some = lambda a: F.when(F.size(a) <= cap, a).otherwise(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.get(a, F.floor(i * F.size(a) / cap).cast("int"))))
    picked = F.get(F.transform(F.array(numbers), some), 0)
    known = done.groupBy(*keys).agg(F.collect_set("house_number").alias("known"))
    left = F.array_except("picked", F.coalesce("known", none))
    return held.select(*keys, picked.alias("picked")).join(known, keys, "left").select(*keys, F.explode(left).alias("house_number"))


def sample_evenly(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows per key: all where there are no more, else those at the places floor(i * n / cap)."""
    one = Window.partitionBy(*keys)
    ranked = df.withColumn("__i", F.row_number().over(one.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(one))
    # place p is taken if some i has floor(i n / cap) = p, that is if ceil(p cap / n) n < (p + 1) cap
    first = F.ceil(F.col("__i") * cap / F.col("__n"))
    return ranked.filter((F.col("__n") <= cap) | (first * F.col("__n") < (F.col("__i") + 1) * cap)).drop("__i", "__n")


def first_tier(work: DataFrame, key: str = "adresa") -> DataFrame:
    """Of each address the row with the smallest tier."""
    rest = [c for c in work.columns if c not in (key, "tier")]
    return work.groupBy(key).agg(F.min(F.struct("tier", *rest)).alias("b")).select(key, "b.*")


def budget_cut(work: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """The first ``cap`` rows: a budget, kept by a top-k."""
    return work.orderBy(*order).limit(cap)


def _grams(c: str, *sizes: int) -> Column:
    """The distinct substrings of ``c`` of each of the sizes."""
    one = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, n)))
    return F.array_distinct(F.concat(*[F.coalesce(one(n), F.array().cast("array<string>")) for n in sizes]))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(x, y) of ``inner`` (x) and ``outer`` (y), both distinct, where y contains x.

    All trigrams of x (x itself if shorter) must be in y, so x is sought by that one which the fewest of ``outer`` hold.
    """
    held = outer.select("y", F.explode(_grams("y", 0, 1, 2, 3)).alias("g"))
    own = F.when(F.length("x") >= 3, _grams("x", 3)).otherwise(F.array("x"))
    grams = inner.filter(F.col("x").isNotNull()).select("x", F.explode(own).alias("g"))
    counts = held.groupBy("g").agg(F.count("*").alias("n"))
    rarest = grams.join(counts, "g", "left").groupBy("x").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("b")).filter("b.n > 0").select("x", F.col("b.g").alias("g"))
    return rarest.join(held, "g").filter(F.contains("y", "x")).select("x", "y")


def containment_match(streets: DataFrame, names: DataFrame) -> DataFrame:
    """(street, name, how): the equal name in lower case or, where there is none, the first by alphabet that contains the street or is contained in it, inside words too; no match: null."""
    s = streets.select("street").distinct().withColumn("s", F.lower(F.trim("street")))
    n = names.select("name").distinct().withColumn("n", F.lower("name"))
    exact = s.join(n, F.col("s") == F.col("n")).groupBy("street").agg(F.min("name").alias("name")).withColumn("how", F.lit("exact"))
    rest = s.join(exact, "street", "left_anti")
    first = n.groupBy("n").agg(F.min("name").alias("name"))
    left, right = rest.select("s").distinct(), first.select("n")
    pairs = contained(left.toDF("x"), right.toDF("y")).toDF("s", "n").unionByName(contained(right.toDF("x"), left.toDF("y")).toDF("n", "s"))
    best = pairs.join(first, "n").groupBy("s").agg(F.min("name").alias("name"))
    part = rest.join(best, "s").select("street", "name", F.lit("contained").alias("how"))
    none = rest.join(part, "street", "left_anti").select("street", F.lit(None).cast("string").alias("name"), F.lit("none").alias("how"))
    return exact.unionByName(part).unionByName(none)


def street_worklist(districts: DataFrame, done: DataFrame) -> DataFrame:
    """(district_id, street) of the districts' street lists, trimmed, without empty and done ones."""
    listed = districts.select("district_id", F.explode("streets").alias("street")).withColumn("street", F.trim("street")).filter("street <> ''").distinct()
    return pending(listed, done, ["district_id", "street"])


def register_worklist(clean: DataFrame, anchors: DataFrame, borders: DataFrame, cache: DataFrame, cap: int | None = 2000) -> DataFrame:
    """(adresa, register_id, tier): tier 1 the anchors, tier 2 the other addresses on border streets; the first tier of an address counts, cached addresses are left out, ``cap`` is the budget."""
    on_border = clean.join(borders.select("municipality_id", F.col("street_norm").alias("ulica_norm")), ["municipality_id", "ulica_norm"], "left_semi").join(anchors.select("register_id"), "register_id", "left_anti")
    work = anchors.select("adresa", "register_id", F.lit(1).alias("tier")).unionByName(on_border.select("adresa", "register_id", F.lit(2).alias("tier")))
    left = pending(first_tier(work), cache, ["adresa"])
    return left if cap is None else budget_cut(left, cap, ["tier", "adresa"])
