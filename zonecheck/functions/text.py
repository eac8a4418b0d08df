"""Column functions over names, texts and codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters with marks and their plain forms.
ACCENTED = "áäàâãåăąāćčçďđéěèêëęēėíîìïīįĺľłńňñóôöőòõøōŕřśšşșťţțúůüűùûūųýÿźžżÁÄÀÂÃÅĂĄĀĆČÇĎĐÉĚÈÊËĘĒĖÍÎÌÏĪĮĹĽŁŃŇÑÓÔÖŐÒÕØŌŔŘŚŠŞȘŤŢȚÚŮÜŰÙÛŪŲÝŸŹŽŻ"
PLAIN = "aaaaaaaaacccddeeeeeeeeiiiiiilllnnnoooooooorrssssttt" + "uuuuuuuuyyzzz" + "AAAAAAAAACCCDDEEEEEEEEIIIIIILLLNNNOOOOOOOORRSSSSTTT" + "UUUUUUUUYYZZZ"

# Condition codes with label and order.
CONDITIONS = {
    "S1": "Š1 — Adresy žiakov a obvod",
    "S2": "Š2 — Topologické pokrytie",
    "S3": "Š3 — Kompozícia obvodu",
    "Pa": "P-a — Vzdialenosť ZŠ 1. stupeň ≤ 2 km",
    "Pb": "P-b — Pešia trasa",
    "Pc": "P-c — MHD dostupnosť",
    "Pd": "P-d — Bariéry (cesty, koľaje)",
    "Pe": "P-e — Sociálny kontext (Atlas MRK)",
    "Pf": "P-f — Demografia detí",
}
# Ranks of severities, severities of verdict values, hosts whose links may be shown.
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2}
VALUE_SEVERITY = {"FAIL": "critical", "INCOMPLETE": "medium", "RISK": "high", "INSUFFICIENT_DATA": "low", "SIGNAL": "medium"}
HOSTS = ["slov-lex.sk", "cvti.sk", "osm.org", "openstreetmap.org", "geoportal.gov.sk", "presov.sk", "gov.sk", "statistics.sk", "atlasromskychkomunit.sk", "minedu.sk", "mzv.sk"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unaccent(c: Column | str) -> Column:
    """Letters without their marks; 'ß' becomes 'ss'."""
    return F.replace(F.translate(_col(c), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def norm_street(c: Column | str) -> Column:
    """The key of a street name: without marks, case, dots, the word 'ulica' at either end and spare spaces; null stays null."""
    named = F.replace(F.replace(_col(c), F.lit("Arm. gen."), F.lit("Armádneho generála")), F.lit("č."), F.lit(""))
    bare = F.regexp_replace(F.lower(unaccent(named)), r"^ulica\s+|\s+ulica$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[.]", " "), r"\s+", " "))


def norm_building_street(c: Column | str) -> Column:
    """The street key for buildings: also without 'č. <number>' and 'ul.'."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), r"č\.\s*\d*", ""), r"\b[uU]l\.\s*", "")
    return F.trim(F.regexp_replace(F.lower(unaccent(bare)), r"\s+", " "))


# The patterns of what is masked, and those of street keys, hosts and links above and below.
MAIL, PHONE, PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?:\+421|00421)[\s\-]?\d{1,4}[\s\-]?\d{3,4}[\s\-]?\d{3,4}|0\d{1,4}[\s\-]?\d{3,4}[\s\-]?\d{3,4}", r"\d{6}\s*/\s*\d{3,4}"


# MAIL begun only where a run of its first characters begins or the last address ended, and the run taken at once: the
# same matches, but a long word without @ is read once, not from each of its characters
_MAIL_ONCE = r"(?:(?<![A-Za-z0-9._%+-])|\G)" + MAIL.replace("]+@", "]++@", 1)


def _masked(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, _MAIL_ONCE, "[email]"), PHONE, "[tel]"), PERSONAL, "[rč]")


def mask_pii(c: Column | str, most: int) -> Column:
    """E-mail addresses, telephone and personal numbers replaced by a tag, then cut to ``most`` characters; null gives ''.

    Nothing that is replaced holds a space between two letters, so a text up to such a place is masked as it would be in
    the whole one. Where the first one after three times ``most`` characters leaves enough, the rest is not looked at.
    """
    whole = F.coalesce(_col(c), F.lit(""))
    begin = F.when(F.length(whole) > 4 * most, F.regexp_extract(whole, rf"(?s)^.{{{3 * most}}}.*?[A-Za-z](?= [A-Za-z])", 0)).otherwise(F.lit(""))
    short = F.left(_masked(begin), F.lit(most))
    return F.when(F.length(short) == most, short).otherwise(F.left(_masked(whole), F.lit(most)))


def url_host(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(_col(c), r"^[Hh][Tt][Tt][Pp][Ss]?://([^/:]+).*$", "$1"))


def host_in_allowlist(c: Column | str, hosts: list[str] = HOSTS) -> Column:
    """Whether the link's host is one of ``hosts`` or below one; null is false."""
    host = url_host(c)
    below = host.isin(hosts)
    for h in hosts:
        below = below | host.endswith("." + h)
    return F.coalesce(below, F.lit(False))


def slug(c: Column | str, as_written: bool = False) -> Column:
    """The name in a link: plain lower-case letters and digits, anything else a dash. ``as_written`` lower-cases last, so that capitals become dashes."""
    before, after = "áäčďéíĺľňóôŕšťúýž", "aacdeillnoorstuyz"
    if as_written:
        return F.lower(F.regexp_replace(F.translate(_col(c), before, after), "[^a-z0-9]+", "-"))
    return F.regexp_replace(F.translate(F.lower(_col(c)), before, after), "[^a-z0-9]+", "-")


def _lookup(c: Column, values: dict, default: Column) -> Column:
    out = default
    for key, value in values.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def condition_label(c: Column | str) -> Column:
    return _lookup(_col(c), CONDITIONS, _col(c))


def condition_order(c: Column | str) -> Column:
    return _lookup(_col(c), {k: i + 1 for i, k in enumerate(CONDITIONS)}, F.lit(99))


def severity_rank(c: Column | str) -> Column:
    return _lookup(_col(c), SEVERITY_RANK, F.lit(1))


def severity_of(value: Column | str) -> Column:
    """The severity of a verdict value; 'info' for all without one of their own."""
    return _lookup(_col(value), VALUE_SEVERITY, F.lit("info"))


def split_outside_parens(c: Column | str) -> Column:
    """Pieces between commas that are not inside parentheses, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(_col(c), r",(?![^(]*\))"), lambda x: F.trim(x)), lambda x: x != "")


def street_entry(c: Column | str) -> Column:
    """struct(street, qualifier): 'Name (qualifier)' taken apart; no qualifier: null."""
    entry = r"^(.+?)\s*\(([^)]+)\)\s*$"
    has = _col(c).rlike(entry)
    return F.struct(
        F.when(has, F.trim(F.regexp_extract(_col(c), entry, 1))).otherwise(F.trim(_col(c))).alias("street"),
        F.when(has, F.trim(F.regexp_extract(_col(c), entry, 2))).alias("qualifier"),
    )


def shared_municipalities(c: Column | str) -> Column:
    """The municipalities in a list, without remarks in parentheses and what follows; empty or a dash gives none."""
    bare = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\(žiaci[^)]*\)|\(ulica:[^)]*\)", "")
    return F.filter(F.transform(F.split(bare, r"[,;]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: ~x.isin("", "–", "-"))


def house_int(c: Column | str) -> Column:
    """The leading digits of a house number as an integer; none: null."""
    return F.regexp_extract(_col(c), r"^\s*(\d+)", 1).try_cast("int")


def only_digits(c: Column | str) -> Column:
    """All digits of a house number read as one integer; none: null."""
    return F.nullif(F.regexp_replace(_col(c), r"\D", ""), F.lit("")).try_cast("int")


def number_list(c: Column | str) -> Column:
    """The numbers of '93 – 101, 105 – 117, 119', in order; pieces that are neither a number nor a range are left out."""
    pieces = F.transform(F.split(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[–—−]", "-"), ","), lambda x: F.trim(x))
    fine = F.filter(pieces, lambda x: x.rlike(r"^\d+(\s*-\s*\d+)?$"))
    return F.flatten(F.transform(fine, lambda x: F.transform(F.split(x, r"\s*-\s*"), lambda y: y.cast("int"))))


def json_text(c: Column | str, path: str) -> Column:
    return F.get_json_object(_col(c), "$." + path)


def json_merge(a: Column, b: Column) -> Column:
    """Two maps as one JSON text; keys of ``b`` win."""
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b))


def any_of(c: Column | str, values: Column | str) -> Column:
    """Whether the array holds the value; a null array holds none."""
    return F.coalesce(F.array_contains(_col(values), _col(c)), F.lit(False))
