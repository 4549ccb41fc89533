"""Scalar featurizers of dates, emails, URLs, texts and targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators.base import Component, features_of

DATE_PARTS = {"year": F.year, "month": lambda c: F.month(c) - 1, "day_of_week": lambda c: F.dayofweek(c) - 1, "hour": F.hour}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


class DateTimeFeaturizer(Component):
    """Year, month (January 0), day of the week (Sunday 0) and hour of each date column, which goes unless it is the time index."""

    def fit_state(self, df, y=None, features_to_extract=None, encode_as_categories=False, time_index=None):
        wanted = list(features_to_extract or DATE_PARTS)
        bad = [f for f in wanted if f not in DATE_PARTS]
        if bad:
            raise ValueError(f"no date features {bad}")
        return {"columns": [c for c in schema.of_type(df, "datetime") if c != y], "parts": wanted}

    def transform(self, df: DataFrame) -> DataFrame:
        s, p = self.learnt(), self.parameters
        new = {}
        for c in s["columns"]:
            for part in s["parts"]:
                value = DATE_PARTS[part](F.col(f"`{c}`"))
                names = {"month": MONTHS, "day_of_week": DAYS}.get(part)
                if p["encode_as_categories"] and names:
                    value = F.get(F.array(*map(F.lit, names)), value)
                new[f"{c}_{part}"] = value
        return df.withColumns(new).drop(*[c for c in s["columns"] if c != p["time_index"]])


#: Mail domains that anybody can get an address of.
FREE_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "mail.com", "gmx.com", "gmx.de", "web.de", "yandex.ru", "mail.ru", "protonmail.com", "zoho.com", "live.com", "msn.com")


def email_domain(c: Column) -> Column:
    """The part after the @ of well-formed addresses, else null."""
    return F.when(c.rlike(schema.EMAIL), F.split_part(c, F.lit("@"), F.lit(-1)))


class EmailFeaturizer(Component):
    def fit_state(self, df, y=None):
        return {"columns": [c for c in schema.of_type(df, "email") if c != y]}

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.learnt()["columns"]:
            domain = email_domain(F.col(f"`{c}`"))
            new[f"{c}_domain"], new[f"{c}_is_free_domain"] = domain, domain.isin(*FREE_DOMAINS)
        return df.withColumns(new).drop(*self.learnt()["columns"])


def _part(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def url_protocol(c: Column) -> Column:
    return _part(c, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://")


def url_domain(c: Column) -> Column:
    return _part(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:www\.)?([^/?#:]+)")


def url_tld(c: Column) -> Column:
    return _part(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#:]*\.([a-zA-Z]+)(?:[/?#:]|$)")


class URLFeaturizer(Component):
    def fit_state(self, df, y=None):
        return {"columns": [c for c in schema.of_type(df, "url") if c != y]}

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.learnt()["columns"]:
            col = F.col(f"`{c}`")
            new |= {f"{c}_protocol": url_protocol(col), f"{c}_domain": url_domain(col), f"{c}_tld": url_tld(col)}
        return df.withColumns(new).drop(*self.learnt()["columns"])


#: ASCII punctuation, which texts lose before they are measured.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def clean_text(c: Column) -> Column:
    return F.lower(F.translate(c, PUNCTUATION, ""))


TEXT_FEATURES = ("num_words", "num_characters", "diversity_score", "mean_characters_per_word")


def text_features(c: Column) -> Column:
    """Words, characters, share of distinct words and mean word length of the normalised text; null for null texts.

    They come as one struct, so that the text is cleaned and split once a row: make it a column, then take its fields.
    """
    plain = clean_text(c)

    def measured(x: Column) -> Column:
        words = F.filter(x["w"], lambda w: w != "")
        n = F.nullif(F.size(words), F.lit(0))
        return F.struct(
            F.size(words).alias("num_words"),
            F.length(x["t"]).alias("num_characters"),
            F.coalesce(F.size(F.array_distinct(words)) / n, F.lit(0.0)).alias("diversity_score"),
            F.coalesce(F.length(F.array_join(words, "")) / n, F.lit(0.0)).alias("mean_characters_per_word"),
        )

    one = F.element_at(F.transform(F.array(F.struct(plain.alias("t"), F.split(plain, r"\s+").alias("w"))), measured), 1)
    return F.when(c.isNotNull(), one)


#: A small lexicon of words that praise or blame.
POLARITY = {"good": 1.0, "great": 1.0, "excellent": 1.0, "happy": 1.0, "love": 1.0, "nice": 0.5, "best": 1.0, "bad": -1.0, "poor": -0.5, "terrible": -1.0, "sad": -1.0, "hate": -1.0, "worst": -1.0, "awful": -1.0}


def polarity(c: Column) -> Column:
    words = F.split(clean_text(c), r"\s+")
    lexicon = F.create_map(*[F.lit(x) for pair in POLARITY.items() for x in pair])
    found = F.filter(F.transform(words, lambda w: F.try_element_at(lexicon, w)), lambda v: v.isNotNull())
    return F.when(c.isNotNull(), F.coalesce(F.aggregate(found, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(found), F.lit(0)), F.lit(0.0)))


class NaturalLanguageFeaturizer(Component):
    def fit_state(self, df, y=None):
        return {"columns": [c for c in schema.of_type(df, "text") if c != y]}

    def transform(self, df: DataFrame) -> DataFrame:
        names = self.learnt()["columns"]
        held = df.withColumns({f"_text_{i}": text_features(F.col(f"`{c}`")) for i, c in enumerate(names)})
        new = {f"{name.upper()}({c})": F.col(f"_text_{i}.{name}") for i, c in enumerate(names) for name in TEXT_FEATURES} | {f"POLARITY_SCORE({c})": polarity(F.col(f"`{c}`")) for c in names}
        return held.withColumns(new).drop(*names, *[f"_text_{i}" for i in range(len(names))])


class LSA(Component):
    """Two components of a truncated singular value decomposition of the texts' TF-IDF vectors."""

    def fit_state(self, df, y=None, num_features=4096):
        from pyspark.ml.feature import IDF, HashingTF
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import RowMatrix

        columns = [c for c in schema.of_type(df, "text") if c != y]
        texts = df.select(F.explode(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns])).alias("t")) if columns else None
        if texts is None:
            return {"columns": [], "idf": [], "directions": []}
        tf = HashingTF(inputCol="w", outputCol="tf", numFeatures=num_features).transform(texts.select(F.split(clean_text(F.col("t")), r"\s+").alias("w")))
        idf = IDF(inputCol="tf", outputCol="x").fit(tf)
        rows = idf.transform(tf).select("x").rdd.map(lambda r: Vectors.fromML(r.x))
        v = RowMatrix(rows, numCols=num_features).computeSVD(2, computeU=False).V.toArray()
        v = v * np.sign(v[np.abs(v).argmax(0), range(v.shape[1])])
        return {"columns": columns, "idf": idf.idf.toArray().tolist(), "directions": v.T.tolist()}

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import HashingTF

        s = self.learnt()
        weights = (np.array(s["directions"]) * np.array(s["idf"])).T if s["columns"] else None

        @F.pandas_udf("array<double>")
        def project(indices: pd.Series, values: pd.Series) -> pd.Series:
            return pd.Series([(np.asarray(v) @ weights[np.asarray(i, dtype=int)]).tolist() if len(i) else [0.0, 0.0] for i, v in zip(indices, values, strict=True)])

        for c in s["columns"]:
            tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=self.parameters["num_features"])
            bucket = tf.transform(df.withColumn("_w", F.split(clean_text(F.coalesce(F.col(f"`{c}`"), F.lit(""))), r"\s+")))
            sparse = F.from_json(F.to_json(F.struct("_tf")), "struct<_tf:struct<indices:array<int>,values:array<double>>>")["_tf"]
            df = bucket.withColumn("_p", project(sparse["indices"], sparse["values"])).withColumns({f"LSA({c})[0]": F.get("_p", F.lit(0)), f"LSA({c})[1]": F.get("_p", F.lit(1))}).drop("_w", "_tf", "_p")
        return df.drop(*s["columns"])


class LogTransformer(Component):
    """Natural logarithm of the label, shifted by |min| + 1 when the minimum is not positive; the minimum is learnt in fit."""

    modifies_target = True

    def fit_state(self, df, y=None):
        low = df.agg(F.min(F.col(f"`{y}`").cast("double"))).first()[0]
        return {"shift": abs(low) + 1 if low is not None and low <= 0 else 0.0}

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.learnt()
        return df.withColumn(s["y"], F.ln(F.col(f"`{s['y']}`").cast("double") + s["shift"])) if s["y"] in df.columns else df

    def inverse_transform(self, df: DataFrame, column: str | None = None) -> DataFrame:
        s = self.learnt()
        column = column or s["y"]
        return df.withColumn(column, F.exp(F.col(f"`{column}`")) - s["shift"])


class DFSTransformer(Component):
    """Depth-one features of single columns: parts of dates, lengths of texts, absolute values and roots of numbers."""

    def fit_state(self, df, y=None, index="index", primitives=("year", "month", "num_characters", "absolute")):
        types = schema.logical_types(df)
        return {"columns": {c: types[c] for c in features_of(df, y) if c != index}}

    def transform(self, df: DataFrame) -> DataFrame:
        wanted, new = self.parameters["primitives"], {}
        for c, kind in self.learnt()["columns"].items():
            col = F.col(f"`{c}`")
            made = {f"{p.upper()}({c})": f(col) for p, f in DATE_PARTS.items() if p in wanted} if kind == "datetime" else {}
            if kind in ("text", "category") and "num_characters" in wanted:
                made[f"NUM_CHARACTERS({c})"] = F.length(col)
            if kind in schema.NUMERIC and "absolute" in wanted:
                made[f"ABSOLUTE({c})"] = F.abs(col)
            new |= {k: v for k, v in made.items() if k not in df.columns}
        return df.withColumns(new)
