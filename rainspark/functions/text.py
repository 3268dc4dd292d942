"""String expressions for station inventories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Brazilian state names (unaccented, lower case) and their two-letter codes.
STATE_CODES = {
    "acre": "AC", "alagoas": "AL", "amapa": "AP", "amazonas": "AM", "bahia": "BA",
    "ceara": "CE", "distrito federal": "DF", "espirito santo": "ES", "goias": "GO",
    "maranhao": "MA", "mato grosso": "MT", "mato grosso do sul": "MS", "minas gerais": "MG",
    "para": "PA", "paraiba": "PB", "parana": "PR", "pernambuco": "PE", "piaui": "PI",
    "rio de janeiro": "RJ", "rio grande do norte": "RN", "rio grande do sul": "RS",
    "rondonia": "RO", "roraima": "RR", "santa catarina": "SC", "sao paulo": "SP",
    "sergipe": "SE", "tocantins": "TO",
}
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def normalise_code8(c: Column) -> Column:
    """Trim, drop a trailing '.0', left-pad with zeros to 8; longer codes stay whole."""
    s = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(F.length(s) < 8, F.lpad(s, 8, "0")).otherwise(s)


def strip_leading_zeros(c: Column) -> Column:
    return F.regexp_replace(F.trim(c.cast("string")), "^0+", "")


def fold_accents(c: Column) -> Column:
    """Letters without accents, also where the accent is a character of its own."""
    return F.regexp_replace(F.translate(c, ACCENTED, UNACCENTED), r"\p{Mn}", "")


def normalise_name(c: Column) -> Column:
    """Unaccented, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), r"\s+", " "))


def state_code(c: Column) -> Column:
    """Two-letter code of a state name, or the text as given."""
    pairs = [F.lit(x) for kv in STATE_CODES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), normalise_name(c)), c)


def is_two_letter(c: Column) -> Column:
    return c.rlike("^[A-Za-z]{2}$")


def trim_number(c: Column, decimals: int = 2) -> Column:
    """Fixed decimals without trailing zeros; NULL becomes the empty string."""
    fixed = F.format_string(f"%.{decimals}f", c.cast("double"))
    return F.when(c.isNull(), "").otherwise(F.regexp_replace(fixed, r"\.?0+$", ""))


def us_date_label(c: Column) -> Column:
    return F.date_format(c, "M/d/yyyy")


def safe_name(c: Column) -> Column:
    """File-name friendly label."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \-]", "_"), r"[()]", "")
