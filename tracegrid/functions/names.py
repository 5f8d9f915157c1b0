"""File names: normal form and the best fuzzy match among siblings."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: code points that names mix up
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2212\u2043\uFE63\uFF0D"
SPACES = "\u00A0\u2007\u202F"


def norm_name(name: Column) -> Column:
    """Hyphens and spaces unified, lower case, trimmed, runs of them one hyphen. Names beyond ASCII take norm_text's way (NFKC), the
    others stay in the JVM: the Arrow function sees null for them."""
    plain = F.regexp_replace(F.trim(F.lower(name)), "[ -]+", "-")
    other = F.when(~name.rlike("^[\\x00-\\x7F]*$"), name)
    return F.coalesce(F.when(other.isNull(), plain), full_norm(other))


@F.pandas_udf(StringType())
def full_norm(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else norm_text(n))


def norm_text(name: str) -> str:
    import re
    import unicodedata

    plain = unicodedata.normalize("NFKC", name).translate({ord(c): "-" for c in HYPHENS} | {ord(c): " " for c in SPACES})
    return re.sub("[ -]+", "-", plain.lower().strip())


def parse_pair(text: Column) -> Column:
    """array(x, y) of a text "x,y"; null where it is anything else."""
    parts = F.split(text, ",", -1)
    values = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(parts) == 2) & F.forall(values, lambda v: v.isNotNull()), values)


def resolve(wanted: DataFrame, siblings: DataFrame, least: float = 0.72) -> DataFrame:
    """wanted (folder, name) with match and ratio: the most similar sibling (folder, file) by matching blocks of the normal names, if above least."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, norm_text(x), norm_text(y)).ratio() for x, y in zip(a, b, strict=True)])

    scored = wanted.join(siblings, "folder").withColumn("ratio", F.when(F.col("name") == F.col("file"), 1.0).otherwise(ratio("name", "file")))
    best = scored.groupBy("folder", "name").agg(F.max(F.struct("ratio", "file")).alias("b")).filter(F.col("b.ratio") > least)
    return best.select("folder", "name", F.col("b.file").alias("match"), F.col("b.ratio").alias("ratio"))
