"""The prepared record: normalised fields and the keys that blocking passes join on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import normalise as N


def prepare(records: DataFrame, dialect: str = "sql", token_source: str = "clean_legal", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records (entity_id, business_name, business_address, country) with their keys; nulls count as empty.

    token_source: whether p1, p2, p3 are tokens of `clean_legal` or of `norm_text`. In the `audit` dialect p2 is the
    first two tokens together, cmp6 a longer prefix, and a missing token is null. keep: columns to leave as they are.
    """
    name, address = F.col("business_name"), F.col("business_address")
    core = N.clean_legal(name, dialect)
    tokens = core if token_source == "clean_legal" else N.norm_text(name, dialect)
    first, second = N.get_token(tokens, 1, dialect), N.get_token(tokens, 2, dialect)
    compact, street = N.compact_name(name, dialect), N.clean_addr(address, dialect)
    fixed = [*keep, "entity_id", F.coalesce("country", F.lit("")).alias("country"), name.alias("raw_name"), address.alias("raw_addr"), N.norm_text(name, dialect).alias("norm_name"), core.alias("core_name")]
    if dialect == "audit":
        return records.select(
            *fixed, N.norm_text(address, dialect).alias("norm_addr"), first.alias("p1"), F.when(F.length(second) > 0, F.concat_ws(" ", first, second)).otherwise(first).alias("p2"),
            second.alias("tok2"), F.substring(compact, 1, 6).alias("cmp6"), F.substring(compact, 1, 7).alias("cmp7"), N.postal(address, dialect).alias("postal"), N.door(address, dialect).alias("door"), N.get_token(street, 1, dialect).alias("a1"),
        )
    return records.select(
        *fixed, street.alias("norm_addr"), first.alias("p1"), second.alias("p2"), N.get_token(tokens, 3).alias("p3"), F.substring(compact, 1, 4).alias("cmp4"), F.substring(compact, 1, 5).alias("cmp5"),
        N.postal(address).alias("postal"), N.door(address).alias("door"), N.get_token(street, 1).alias("a1"), N.get_token(street, 2).alias("a2"),
    )
