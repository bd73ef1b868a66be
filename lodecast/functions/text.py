"""Names, seeds and texts of numbers."""

from __future__ import annotations

import ast
import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def period_name(period: Column) -> Column:
    """The three months of a period, as in 04_05_06."""
    return F.format_string("%02d_%02d_%02d", period, period + 1, period + 2)


def numbers(text: Column) -> Column:
    """The array of doubles in a text such as ``[1.5 2 3e-4]`` or ``[1.5, 2]``; other texts are null."""
    inner = F.trim(F.regexp_replace(text, r"[\[\],\s]+", " "))
    parts = F.transform(F.filter(F.split(inner, " "), lambda p: p != ""), lambda p: p.try_cast("double"))
    return F.when(text.rlike(r"^\s*\[.*\]\s*$") & ~F.exists(parts, lambda p: p.isNull()), parts)


def numbers_text(values: Column) -> Column:
    """An array of doubles as a text, ``[a b c]``, each as short as it reads back."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), " "), F.lit("]"))


def initial_state(period: str, domain: str) -> int:
    """The state of the generator of a period's and domain's paths: a hash of both names, eight digits of it."""
    return int(hashlib.sha256(f"{period}:{domain}".encode()).hexdigest(), 16) % 10**8


def path_seeds(period: str, domain: str, n: int) -> list[int]:
    """The seeds of ``n`` realisations of a period and domain."""
    return np.random.default_rng(initial_state(period, domain)).integers(0, 2**31, n).tolist()


def plain_name(method: str) -> str:
    return "".join(c for c in method.lower() if c not in "-()")


def gp_serial(method: str, rotated: bool = True, scored: bool = False, prefix: str = "", train: str = "gb", infer: str = "lb") -> str:
    """The name of a Gaussian process experiment: [prefix_]method[r]_<train>t_<infer>i[_nst].

    ``train`` and ``infer`` start with l (local) or g (global), then b for blast holes and e for exploration samples.
    """
    name = plain_name(method.lower().replace("gpr", "gp"))
    return f"{prefix + '_' if prefix else ''}{name}{'r' if rotated else ''}_{train}t_{infer}i{'_nst' if scored else ''}"


def literal(text: str):
    """A value written as a literal, or the text itself."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text
