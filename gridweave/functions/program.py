"""Field programs: scalar fields as ordered steps of SQL expressions and noise samples.

A step binds names that later steps may use. Expressions are plain SQL over the
columns at hand, so one program runs as DataFrame projections and vectorised
noise samples, and can be written out as a chain of SQL stages.
Decimal numbers count as doubles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice, noise

_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def doubles(expr: str) -> str:
    """The expression with decimal literals in exponent form, which is a double in any dialect."""
    return _DECIMAL.sub(r"\1e0", expr)


def num(v: float) -> str:
    """A number as an operand."""
    return f"({float(v)!r})"


def clamp(x: str, lo: float | str = 0.0, hi: float | str = 1.0) -> str:
    of = lambda v: v if isinstance(v, str) else num(v)
    return f"least(greatest({x}, {of(lo)}), {of(hi)})"


def ease(t: str) -> str:
    """3t^2 - 2t^3 of a name whose value is in [0, 1]."""
    return f"({t} * {t} * (3.0 - 2.0 * {t}))"


def quintic(t: str) -> str:
    return f"({t} * {t} * {t} * ({t} * ({t} * 6.0 - 15.0) + 10.0))"


@dataclass
class Program:
    """steps: ("let", {name: expression}) or (a noise kind, {name: (x, z, seed)})."""

    steps: list[tuple[str, dict]] = field(default_factory=list)

    def let(self, **exprs: str) -> Program:
        """Binds names in turn: each may use those before it."""
        self.steps += [("let", {k: doubles(e)}) for k, e in exprs.items()]
        return self

    def sample(self, kind: str, **at: tuple[str, str, int]) -> Program:
        """Noise samples that do not depend on each other; kind is one of noise.KINDS, or worley for nearest distances name1 and name2."""
        self.steps.append((kind, {k: (doubles(x), doubles(z), s) for k, (x, z, s) in at.items()}))
        return self

    def fbm(self, name: str, x: str, z: str, p: noise.Fractal, kind: str = "perlin") -> Program:
        """Octave sum over its own weight, clamped and remapped as noise.fbm does."""
        at = {f"{name}_o{o}": (f"({x} + {num(p.offset_x)}) * {num(f)}", f"({z} + {num(p.offset_z)}) * {num(f)}", p.seed + 1013 * o) for o, (f, _) in enumerate(p.levels())}
        self.sample(kind, **at)
        total = " + ".join(f"{n} * {num(a)}" for n, (_, a) in zip(at, p.levels(), strict=True))
        span = max(p.remap_max - p.remap_min, 1e-6)
        return self.let(**{name: f"(-1.0 + 2.0 * {clamp(f'(({total}) / {num(sum(a for _, a in p.levels()))} - {num(p.remap_min)}) / {num(span)}')}) * {num(p.amplitude)}"})

    def ridged(self, name: str, x: str, z: str, p: noise.Fractal, kind: str = "perlin") -> Program:
        """Ridged multifractal in [0, amplitude]."""
        at = {f"{name}_o{o}": (f"({x} + {num(p.offset_x)}) * {num(f)}", f"({z} + {num(p.offset_z)}) * {num(f)}", p.seed + 9173 * o) for o, (f, _) in enumerate(p.levels())}
        self.sample(kind, **at)
        before = None
        for n in at:
            r = clamp(f"1.0 - abs({n})")
            self.let(**{f"{n}s": f"{r} * {r}" + (f" * {clamp(f'{before} * 2.0')}" if before else "")})
            before = f"{n}s"
        total = " + ".join(f"{n}s * {num(a)}" for n, (_, a) in zip(at, p.levels(), strict=True))
        return self.let(**{name: f"{clamp(f'({total}) / {num(sum(a for _, a in p.levels()))}')} * {num(p.amplitude)}"})


def names_of(kind: str, name: str) -> list[str]:
    """The columns that a sample binds."""
    return [f"{name}1", f"{name}2"] if kind == "worley" else [name]


def _sampler(kind: str, seeds: list[int], names: list[str]):
    """A vectorised function from x, z of each sample to all fields of one step."""
    of = lattice.KINDS[kind]

    def sample(*xz: pd.Series) -> pd.DataFrame:
        out = []
        for k, s in enumerate(seeds):
            got = of(xz[2 * k].to_numpy(float), xz[2 * k + 1].to_numpy(float), s)
            out += got if isinstance(got, tuple) else [got]
        return pd.DataFrame(dict(zip(names, out, strict=True)))

    return F.pandas_udf(sample, ", ".join(f"{n} {'long' if kind == 'hash' else 'double'}" for n in names))


def run(df: DataFrame, program: Program, *out: str) -> DataFrame:
    """df with the named fields of the program; no shuffle. Expressions run in generated code, each noise step on Arrow batches."""
    d = df
    for kind, what in program.steps:
        if kind == "let":
            d = d.withColumns({k: F.expr(e) for k, e in what.items()})
            continue
        names = [n for k in what for n in names_of(kind, k)]
        f = _sampler(kind, [s for _, _, s in what.values()], names)
        d = d.withColumn("__sampled", f(*(F.expr(f"cast({e} as double)") for x, z, _ in what.values() for e in (x, z))))
        d = d.withColumns({n: F.col(f"__sampled.{n}") for n in names}).drop("__sampled")
    return d.select(*(c for c in df.columns if c not in out), *out)
