"""Preprocessing and feature recipes: fixed compositions of the operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from rowloom.layout import DEFAULT, Layout
from rowloom.operators import categories as cat
from rowloom.operators import numeric as num
from rowloom.operators.columns import (
    categorical_columns,
    col,
    differs_flag,
    drop_matching,
    map_label,
    numeric_columns,
    positive_flag,
    q,
    rename_known,
)
from rowloom.operators.crosses import CrossMeans
from rowloom.operators.folds import stratified_folds
from rowloom.operators.joins import joined_to_itself
from rowloom.operators.sets import tag_union, union_lenient
from rowloom.session import release, settle
from rowloom.sources.tables import write_features


@dataclass(frozen=True)
class Roles:
    """Columns that recipes treat in a special way.

    The defaults are fixed values: the column names of a bank-campaign table.
    """

    renames: Mapping[str, str] = field(default_factory=lambda: {"y": "target"})
    label_codes: Mapping[str, int] = field(default_factory=lambda: {"yes": 1, "no": 0})
    positive_flags: tuple[str, ...] = ("previous",)
    sentinel_flags: Mapping[str, float] = field(default_factory=lambda: {"pdays": -1})
    power: tuple[str, ...] = ("balance", "campaign", "duration")
    excluded: tuple[str, ...] = ("default",)
    sentinels: Mapping[str, float] = field(
        default_factory=lambda: {
            "balance": 0, "campaign": 0, "pdays": -1, "previous": 0, "duration": 0,
        }
    )
    unbinned: tuple[str, ...] = ("age", "day")


BANK = Roles()

# preprocessing version -> (adds original rows, transforms numerics, tail to winsorise)
PREPROCESSING = {
    1: (False, False, None),
    2: (True, False, None),
    3: (False, True, None),
    4: (False, True, 0.01),
    5: (False, True, 0.05),
}


def preprocess(
    train: DataFrame, test: DataFrame, version: int, original: DataFrame | None = None,
    roles: Roles = BANK, layout: Layout = DEFAULT, scope: str = "all",
) -> DataFrame:
    """One tagged table out of raw train and test rows (and extra labelled ones)."""
    adds_original, transforms, tail = PREPROCESSING[version]
    train, test = rename_known(train, roles.renames), rename_known(test, roles.renames)
    if adds_original:
        if original is None:
            raise ValueError(f"preprocessing {version} needs the original rows")
        extra = map_label(rename_known(original, roles.renames), layout.label, roles.label_codes)
        train = union_lenient(train.withColumn(layout.label, col(layout.label).cast("long")), extra)
    out = tag_union(train, test.drop(layout.label), layout)
    if not transforms:
        return out
    flags = {c: positive_flag(c) for c in roles.positive_flags}
    flags |= {c: differs_flag(c, v) for c, v in roles.sentinel_flags.items()}
    # limits, exponents and scales are each learnt from passes over the rows, which are read from one written table
    out = settle(num.replace_columns(out, flags), "prepared")
    power = list(roles.power)
    if tail is not None:
        out = num.Winsorizer.fit(out, power, tail, scope, layout).transform(out)
    return num.YeoJohnson.fit(out, power, scope, layout).transform(out)


class _Builder:
    """Shared steps of the feature recipes over one tagged table."""

    def __init__(self, df: DataFrame, roles: Roles, layout: Layout, scope: str, k: int, seed: int):
        self.df, self.roles, self.layout, self.scope, self.k = df, roles, layout, scope, k
        self.seed = seed
        self.text, self.numbers = categorical_columns(df, layout), numeric_columns(df, layout)
        self.carried = [
            c for c in (layout.id, layout.split, layout.fold, layout.weight, layout.label)
            if c in df.columns
        ]

    def stored(self) -> _Builder:
        """Self with its table written: every encoder is fitted and applied by passes of its own."""
        self.df = settle(self.df, "table", passing=True)
        return self

    def with_folds(self) -> DataFrame:
        if self.layout.fold not in self.df.columns:
            # written once: fitting and applying the encoders both read the fold
            folded = settle(stratified_folds(self.df, self.k, self.seed, self.layout), "folds", passing=True)
            release(self.df)
            self.df = folded
            self.carried.append(self.layout.fold)
        return self.df

    def scale(self, df: DataFrame, names: list[str]) -> DataFrame:
        return num.Standardizer.fit(df, names, self.scope, self.layout).transform(df)

    def codes(self, df: DataFrame) -> DataFrame:
        if not self.text:
            return df
        return cat.LabelCodes.fit(df, self.text, self.scope, self.layout).transform(
            df, layout=self.layout
        )

    def encode(self, df: DataFrame, names: list[str]) -> DataFrame:
        if not names:
            return df
        return cat.TargetEncoder.fit(df, names, self.k, self.layout).transform(df, self.layout)

    def take(self, df: DataFrame, names: list[str]) -> DataFrame:
        return df.select(*[q(c) for c in self.carried + names])


def _codes_raw(b: _Builder) -> DataFrame:
    return b.take(b.codes(b.df), b.numbers + b.text)


def _hot_scaled(b: _Builder) -> DataFrame:
    hot = cat.OneHot.fit(b.df, b.text, scope=b.scope, layout=b.layout)
    return b.take(hot.transform(b.scale(b.df, b.numbers)), b.numbers + hot.names())


def _means_scaled(b: _Builder) -> DataFrame:
    df = b.with_folds()
    many, few = cat.route_by_cardinality(df, b.text, 3, b.roles.excluded)
    hot = cat.OneHot.fit(df, few, drop_first=True, scope=b.scope, layout=b.layout)
    scaled = b.numbers + [f"{c}_te" for c in many]
    out = hot.transform(b.scale(b.encode(df, many), scaled))
    return b.take(out, scaled + hot.names())


def _codes_scaled(b: _Builder) -> DataFrame:
    return b.take(b.codes(b.scale(b.df, b.numbers)), b.numbers + b.text)


def _products(b: _Builder) -> DataFrame:
    hot = cat.OneHot.fit(
        b.df, b.text, kind="int", null_name="null", scope=b.scope, layout=b.layout
    )
    factors = hot.names() + b.numbers
    out = num.add_products(hot.transform(b.scale(b.df, b.numbers)), factors)
    return b.take(out, b.numbers + hot.names() + [n for *_, n in num.product_columns(factors)])


def _codes_binned(b: _Builder) -> DataFrame:
    binned = [c for c in b.numbers if c not in b.roles.unbinned]
    plain = [c for c in b.numbers if c in b.roles.unbinned]
    bins = num.QuantileBins.fit(
        b.df, binned, 100, b.roles.sentinels, scope=b.scope, layout=b.layout
    )
    out = bins.transform(b.df)
    out = num.replace_columns(out, {c: col(c).cast("string") for c in plain})
    return b.take(b.codes(out), plain + binned + b.text)


def _means_raw(b: _Builder) -> DataFrame:
    df = b.encode(b.with_folds(), b.text)
    return b.take(df, b.numbers + [f"{c}_te" for c in b.text])


def _cross_means(b: _Builder) -> DataFrame:
    df = b.with_folds()
    order = [c for c in df.columns if c in b.text or c in b.numbers]
    names = [n for *_, n in cat.cross_columns(order)]
    means = [f"{n}_te" for n in names]
    encoder = cat.TargetEncoder.fit(df, b.text, b.k, b.layout) if b.text else None
    if encoder is None or encoder.small:
        # columns of a row stay beside its crosses, so the widest table is not joined
        encoded = encoder.transform(df, b.layout) if encoder else df
        fitted = CrossMeans.fit(encoded, order, b.k, b.layout, b.carried + b.numbers + [f"{c}_te" for c in b.text])
        release(df)
        out = joined_to_itself(fitted.transform(b.layout), fitted.coded.select(b.layout.id), means, b.layout.id)
    else:
        crossed = CrossMeans.fit(df, order, b.k, b.layout).transform(b.layout)
        out = encoder.transform(df, b.layout).join(crossed, b.layout.id)
    out = b.take(out, b.numbers + [f"{c}_te" for c in b.text] + means)
    # columns made from the label are never built; ones the caller brought are dropped
    return drop_matching(out, f"_{b.layout.label}", keep=b.carried)


FEATURES = {
    1: _codes_raw,
    2: _hot_scaled,
    3: _means_scaled,
    4: _codes_scaled,
    5: _products,
    6: _codes_binned,
    7: _means_raw,
    8: _cross_means,
}


def features(
    df: DataFrame, recipe: int, roles: Roles = BANK, layout: Layout = DEFAULT, scope: str = "all",
    k: int = 5, seed: int = 42,
) -> DataFrame:
    """Apply a feature recipe to a tagged table; id, split, label (and fold, weight) stay.

    Encoders learn from train and test rows together, or with ``scope="train"``
    from train rows only. Label means always come from train rows.
    """
    return FEATURES[recipe](_Builder(df, roles, layout, scope, k, seed).stored())


# feature-set version -> (preprocessing version, feature recipe)
FEATURE_SETS = {
    1: (1, 1), 2: (1, 2), 3: (2, 1), 4: (3, 2), 5: (3, 3), 6: (4, 2),
    7: (5, 2), 8: (4, 4), 9: (4, 5), 10: (1, 6), 11: (1, 7), 12: (1, 8),
}


def feature_set(
    train: DataFrame, test: DataFrame, version: int, original: DataFrame | None = None,
    roles: Roles = BANK, layout: Layout = DEFAULT, root: str | None = None,
) -> DataFrame:
    """A numbered feature set from raw tables; stored below ``root`` if one is given."""
    prepared, recipe = FEATURE_SETS[version]
    df = features(preprocess(train, test, prepared, original, roles, layout), recipe, roles, layout)
    if root is None:
        return df
    path = write_features(df, root, version, layout)
    return df.sparkSession.read.parquet(path)
