"""Ordinance texts to district blocks, street entries and house ranges."""

from __future__ import annotations

import difflib
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..sources.shared import stored

_HEAD = r"(?m)^(\d+)\.\s+(Základná škola[^:]+):\s*$"


def ordinance_blocks(texts: DataFrame, key: str = "vzn_id", text: str = "raw_text") -> DataFrame:
    """(key, number, school_name, address, streets_text, municipalities): the numbered district blocks of each text, up to the next one; the part after 'Obec:' names shared municipalities."""
    blocks = F.filter(F.split(F.col(text), r"(?m)(?=^\d+\.\s+Základná škola[^:]+:\s*$)"), lambda b: b.rlike(_HEAD))
    b = texts.select(key, F.explode(blocks).alias("b"))
    head = F.regexp_extract("b", _HEAD, 2)
    body = F.regexp_replace("b", r"(?s)^\d+\.\s+Základná škola[^:]+:[ \t]*\n?", "")
    parts = F.split(body, r"\nObec:\s*", 2)
    return b.select(
        key, F.regexp_extract("b", _HEAD, 1).cast("int").alias("number"), F.trim(F.regexp_extract(head, r"^([^,]+)", 1)).alias("school_name"),
        F.nullif(F.trim(F.regexp_extract(head, r"^[^,]+,\s*(.+)$", 1)), F.lit("")).alias("address"), F.trim(F.get(parts, 0)).alias("streets_text"), T.shared_municipalities(F.get(parts, 1)).alias("municipalities"),
    )


def street_entries(blocks: DataFrame) -> DataFrame:
    """(keys of the block, street, qualifier): one row per entry; a street listed twice keeps both."""
    flat = F.regexp_replace("streets_text", r"\s*\n\s*", " ")
    kept = [c for c in blocks.columns if c != "streets_text"]
    return blocks.select(*kept, F.explode(T.split_outside_parens(flat)).alias("e")).select(*kept, T.street_entry("e").alias("s")).select(*kept, "s.street", "s.qualifier")


def _range(kind: str, numbers: Column) -> Column:
    return F.struct(F.lit(kind).alias("range_type"), numbers.alias("numbers"))


def street_ranges(entries: DataFrame) -> DataFrame:
    """Entries with range_type and numbers, a row per range: odd and even with their numbers (none: all), single, range, or all without a qualifier.

    Odd and even parts of one qualifier are told apart by whole words, so 'nepárne' is never read as 'párne' too.
    """
    q = F.trim("qualifier")
    bare = F.regexp_replace(F.regexp_replace(q, r"čísl[oa]\s*|č\.\s*", ""), r"\bod\s+", "")
    none = F.array().cast("array<int>")
    odd_text = F.regexp_extract(bare, r"(?iu)nepárne\s*(.*?)(?=(?<!ne)párne|$)", 1)
    even_text = F.regexp_extract(bare, r"(?iu)(?<!ne)párne\s*(.*?)(?=nepárne|$)", 1)
    has_odd, has_even = q.rlike(r"(?iu)nepárne"), q.rlike(r"(?iu)(?<!ne)párne")
    parity = F.array_compact(F.array(F.when(has_odd, _range("odd", T.number_list(odd_text))), F.when(has_even, _range("even", T.number_list(even_text)))))
    singles = F.transform(F.regexp_extract_all(q, F.lit(r"(?iu)číslo\s+(\d+)"), F.lit(1)), lambda x: _range("single", F.array(x.cast("int"))))
    listed = T.number_list(bare)
    ranges = (
        F.when(F.col("qualifier").isNull() | (q == ""), F.array(_range("all", none)))
        .when(has_odd | has_even, parity).when(F.size(singles) > 0, singles).when(q.rlike(r"^\d+$"), F.array(_range("single", listed)))
        .when(F.size(listed) > 0, F.array(_range("range", listed))).otherwise(F.array(_range("all", none)))
    )
    return entries.withColumn("r", F.explode(ranges)).select(*entries.columns, "r.range_type", "r.numbers")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts: twice the matching characters over both lengths."""
    return _ratio(a, b)


def _most(a: str, codes: np.ndarray, letters: dict[str, int], lengths: np.ndarray) -> np.ndarray:
    """For the texts of ``codes`` (a row of letter numbers each, padded by the last number) a ratio to ``a`` that none exceeds: what matches is a common subsequence, whose longest length comes from one bit per letter of ``a``."""
    if len(a) > 64:
        held = Counter(a)
        common = sum(np.minimum((codes == letters[c]).sum(axis=1), n) for c, n in held.items() if c in letters) + np.zeros(len(codes), int)
    else:
        masks = np.zeros(len(letters) + 1, np.uint64)
        for i, c in enumerate(a):
            if c in letters:
                masks[letters[c]] |= np.uint64(1 << i)
        v = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(codes.shape[1]):
            u = v & masks[codes[:, j]]
            v = (v + u) | (v - u)
        common = np.bitwise_count(~v & np.uint64((1 << len(a)) - 1)).astype(int)
    return 2.0 * common / np.maximum(len(a) + lengths, 1)


def _closest(wanted: list[str], keys: list[str], names: list[str], floor: float) -> tuple[list[str | None], list[float]]:
    """For each wanted key the name of the key with the highest ratio, of equal ones the first name, and that ratio; none below ``floor``."""
    letters = {c: n for n, c in enumerate(sorted(set("".join(keys))))}
    lengths = np.array([len(k) for k in keys], int)
    codes = np.full((len(keys), max(map(len, keys), default=0)), len(letters), np.int32)
    for i, k in enumerate(keys):
        codes[i, :len(k)] = [letters[c] for c in k]
    best: list[str | None] = []
    scores: list[float] = []
    for a in wanted:
        name, score = None, 0.0
        if a is not None and len(keys):
            most = _most(a, codes, letters, lengths)
            for j in np.argsort(-most, kind="stable"):
                if most[j] <= 0 or most[j] < max(score, floor):
                    break
                x = difflib.SequenceMatcher(None, a, keys[j]).ratio()
                if x >= floor and (x > score or (x == score and name is not None and names[j] < name)):
                    name, score = names[j], x
        best.append(name)
        scores.append(score)
    return best, scores


#: Ordinance streets, and register keys, that one task compares.
BLOCK = 512


def closest_keys(wanted: DataFrame, keys: DataFrame, floor: float, block: int | None = None) -> DataFrame:
    """(municipality_id, k, best, score): for each k of ``wanted`` (municipality_id, k) the name of the key of its municipality with the highest ratio, of equal ones the first name; k without one from ``floor`` on are left out.

    ``keys`` has (municipality_id, rk, best). Both sides are dealt out in blocks of about ``block`` rows, so a task
    compares a bounded number of pairs however large a municipality is. A block's keys are of like length: texts of
    which one is longer than 2 / floor - 1 times the other cannot reach the floor, and such blocks don't meet.
    """
    block = BLOCK if block is None else block
    wanted = wanted.filter("municipality_id is not null and k is not null").select("municipality_id", "k").distinct()
    keys = keys.filter("municipality_id is not null and rk is not null")
    # with a ratio of floor, 2 * shorter / (shorter + longer) >= floor
    most = 2 / floor - 1 if floor > 0 else None
    step = math.log(most) if most and most > 1 else 1.0
    kind = lambda c: (F.floor(F.log(F.greatest(F.length(c), F.lit(1)).cast("double")) / step + 1e-9) if most else F.lit(0)).cast("int")
    w, r = wanted.withColumn("__class", kind("k")), keys.withColumn("__class", kind("rk"))
    blocks = lambda df, n: df.groupBy("municipality_id", "__class").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    near = F.explode(F.array(*[F.col("__class") + i for i in ((-1, 0, 1) if most else (0,))]))
    sizes = stored(blocks(w, "__n").withColumn("__with", near).join(blocks(r, "__m").withColumnRenamed("__class", "__with"), ["municipality_id", "__with"]))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = ["municipality_id", "__class", "__with", "__a", "__b"]
    left = w.join(sizes, ["municipality_id", "__class"]).withColumn("__a", part("k", "__n")).withColumn("__b", every("__m"))
    right = r.withColumnRenamed("__class", "__with").join(sizes, ["municipality_id", "__with"]).withColumn("__b", part("rk", "__m")).withColumn("__a", every("__n"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best, score = _closest(list(a["k"]), list(b["rk"]), list(b["best"]), floor)
        return pd.DataFrame({"municipality_id": a["municipality_id"], "k": a["k"], "best": best, "score": score}).dropna(subset=["best"])

    kinds = dict(wanted.dtypes)
    met = left.select(*at, "k").groupBy(*at).cogroup(right.select(*at, "rk", "best").groupBy(*at)).applyInPandas(compare, f"municipality_id {kinds['municipality_id']}, k string, best string, score double")
    best = met.groupBy("municipality_id", "k").agg(F.min(F.struct((-F.col("score")).alias("s"), "best")).alias("b"))
    return best.select("municipality_id", "k", "b.best", (-F.col("b.s")).alias("score"))


def classify_streets(ordinance: DataFrame, register: DataFrame, threshold: float = 0.8, nearest: bool = False) -> DataFrame:
    """(municipality_id, street, match_class, best, score) of ordinance streets against register streets of the same municipality: EXACT, NORMALIZED, FUZZY by the ratio of keys, else NOT_FOUND.

    A street that is neither EXACT nor NORMALIZED is compared with the keys whose length allows the threshold. With
    ``nearest``, those that stay NOT_FOUND are compared with all keys of their municipality, and give the best one and
    its score too (null and 0 where no letter is shared), else null. Bounds from the longest common subsequence leave
    out keys that cannot be the best, which changes no result.
    """
    o = ordinance.select("municipality_id", "street").distinct().withColumn("k", T.norm_street("street"))
    r = register.select("municipality_id", F.col("ulica").alias("best")).distinct().withColumn("rk", T.norm_street("best"))
    keys = r.groupBy("municipality_id", "rk").agg(F.min("best").alias("best"))
    exact = o.join(r, (o["municipality_id"] == r["municipality_id"]) & (o["street"] == r["best"]), "left_semi")
    rest = o.join(exact, ["municipality_id", "street"], "left_anti")
    normal = rest.join(keys, (rest["municipality_id"] == keys["municipality_id"]) & (rest["k"] == keys["rk"])).select(rest["municipality_id"], "street", "best")
    rest = rest.join(normal, ["municipality_id", "street"], "left_anti")
    rest = stored(rest)
    found = stored(closest_keys(rest, keys, threshold))
    if nearest:
        open_ = rest.join(found.select("municipality_id", "k"), ["municipality_id", "k"], "left_anti")
        found = found.unionByName(closest_keys(open_, keys, 0.0))
    f = found.withColumnsRenamed({"municipality_id": "__m", "k": "__k"})
    found = rest.join(f, (F.col("municipality_id") == F.col("__m")) & (F.col("k") == F.col("__k")), "left").select("municipality_id", "street", "best", F.coalesce("score", F.lit(0.0)).alias("score"))
    fuzzy = F.col("score") >= threshold
    shown = fuzzy | F.lit(nearest)
    kinds = lambda df, kind, best, score: df.select("municipality_id", "street", kind.alias("match_class"), best.alias("best"), score.cast("double").alias("score"))
    return (
        kinds(exact, F.lit("EXACT"), F.col("street"), F.lit(1.0)).unionByName(kinds(normal, F.lit("NORMALIZED"), F.col("best"), F.lit(1.0)))
        .unionByName(kinds(found, F.when(fuzzy, "FUZZY").otherwise("NOT_FOUND"), F.when(shown, F.col("best")), F.when(shown, F.round("score", 3))))
    )


def geometry_confidence(matches: DataFrame) -> DataFrame:
    """(district_id, streets, resolved, confidence) from (district_id, street, resolved): high above 0.9 of its streets, medium above 0.6, else low; none without streets resolved."""
    per = matches.groupBy("district_id").agg(F.count("*").alias("streets"), F.count_if("resolved").alias("resolved"))
    share = F.col("resolved") / F.col("streets")
    return per.withColumn("confidence", F.when(F.col("resolved") == 0, "none").when(share > 0.9, "high").when(share > 0.6, "medium").otherwise("low"))
