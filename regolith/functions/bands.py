"""Column expressions over bands: compiled ratio formulas, spectral indices, continuum depth, clipping."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the least denominator of a ratio, and the least continuum of a band depth.
RATIO_EPS, CONTINUUM_FLOOR = 1e-6, 1e-4
BAND_NAME = re.compile(r"B\d+A?")


def finite(x: Column) -> Column:
    """x where it is a finite number, null where it is NaN or infinite: Spark puts NaN above all numbers, and one makes a mean NaN."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def safe_ratio(a: Column, b: Column, eps: float = RATIO_EPS) -> Column:
    """a / b, null where |b| is not over eps."""
    return F.when(F.abs(b) > eps, a / b)


_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: safe_ratio}


def band_expression(text: str, bands: Mapping[str, Column]) -> Column:
    """A Column for a formula such as '(B5+B7)/B6': bands, numbers, + - * / and parentheses, nothing else. Divisions are safe
    ratios. ValueError for other syntax, unknown bands, or a formula without a band. Catalyst folds and shares the rest."""

    def build(node: ast.expr) -> Column:
        match node:
            case ast.BinOp(left, op, right) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](build(left), build(right))
            case ast.UnaryOp(ast.USub(), inner):
                return -build(inner)
            case ast.UnaryOp(ast.UAdd(), inner):
                return build(inner)
            case ast.Constant(value) if type(value) in (int, float):
                return F.lit(float(value))
            case ast.Name(name) if name in bands and BAND_NAME.fullmatch(name):
                return bands[name].cast("double")
        raise ValueError(f"not allowed in a band formula: {ast.unparse(node)}")

    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as broken:
        raise ValueError(f"not a band formula: {text}") from broken
    column = build(tree)
    if not any(isinstance(n, ast.Name) for n in ast.walk(tree)):
        raise ValueError("a band formula names at least one band")
    return column


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within bounds; null stays null, which greatest and least alone would lose."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def ndvi(nir: Column, red: Column) -> Column:
    return safe_ratio(nir - red, nir + red)


def ndre(nir: Column, red_edge: Column) -> Column:
    return safe_ratio(nir - red_edge, nir + red_edge)


def cire(red_edge_3: Column, red_edge_1: Column) -> Column:
    return safe_ratio(red_edge_3, red_edge_1) - 1


def rep(red: Column, re1: Column, re2: Column, re3: Column) -> Column:
    """Red-edge position in nm."""
    return 705 + 35 * safe_ratio((red + re3) / 2 - re1, re2 - re1)


def bsi(blue: Column, red: Column, nir: Column, swir1: Column) -> Column:
    return safe_ratio((swir1 + red) - (nir + blue), (swir1 + red) + (nir + blue))


def window_bands(wavelengths: Sequence[float], target: float, window: float = 0.01) -> list[int]:
    """The bands within the window of the target wavelength, or the nearest one; chosen when the plan is made."""
    apart = [abs(w - target) for w in wavelengths]
    return [i for i, d in enumerate(apart) if d <= window] or [apart.index(min(apart))]


def reflectance_at(spectrum: Column, wavelengths: Sequence[float], target: float, window: float = 0.01) -> Column:
    """The mean of the spectrum's known values near a wavelength."""
    values = [F.get(spectrum, F.lit(i)).cast("double") for i in window_bands(wavelengths, target, window)]
    known = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(known > 0, sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)) / known)


def band_depth(spectrum: Column, wavelengths: Sequence[float], feature: float, shoulders: tuple[float, float], sign: int = 1) -> Column:
    """Continuum-removed depth of an absorption, null where the continuum is at the floor or below it."""
    left, right = shoulders
    r, a, b = (reflectance_at(spectrum, wavelengths, w) for w in (feature, left, right))
    continuum = (a + b) / 2 if abs(right - left) < 1e-9 else a + (b - a) * ((feature - left) / (right - left))
    return F.when(continuum > CONTINUUM_FLOOR, sign * (1 - r / continuum))


def vegetation_stress(red: Column, re1: Column, re2: Column, re3: Column, nir: Column, index: str = "ndre", floor: float = 0.30) -> Column:
    """Minus the vigour (ndre, cire or rep) where NDVI is over the floor."""
    vigour = {"ndre": ndre(nir, re1), "cire": cire(re3, re1), "rep": rep(red, re1, re2, re3)}[index]
    return F.when(ndvi(nir, red) > floor, -vigour)
