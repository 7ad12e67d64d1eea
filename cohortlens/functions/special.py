"""Special functions as SQL expressions of plain columns, in a fixed number of steps."""

from __future__ import annotations

STEPS = 220      # of the series and of the continued fraction; enough for a <= LARGE_A
LARGE_A = 200.0  # above it the uniform expansion is used: its error falls with 1 / a^2


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which then stands in the expression once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def erfc_sql(z: str) -> str:
    """erfc(z) for any z (Numerical Recipes erfcc, relative error < 1.2e-7)."""
    t = f"(1.0 / (1.0 + 0.5 * abs({z})))"
    poly = ("(-1.26551223 + {t} * (1.00002368 + {t} * (0.37409196 + {t} * (0.09678418 + {t} * "
            "(-0.18628806 + {t} * (0.27886807 + {t} * (-1.13520398 + {t} * (1.48851587 + {t} * "
            "(-0.82215223 + {t} * 0.17087277)))))))))").format(t=t)
    tail = f"({t} * exp(-({z}) * ({z}) + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 2.0 - {tail} END)"


def log_gamma_sql(a: str) -> str:
    """ln Gamma(a) for a > 0: Stirling's series at a + 8, taken back by the product of the eight factors."""
    z = f"({a} + 8.0)"
    product = " * ".join(f"({a} + {k}.0)" for k in range(8))
    return (f"(({z} - 0.5) * ln({z}) - {z} + 0.5 * ln(2.0 * pi()) + 1.0 / (12.0 * {z}) - 1.0 / (360.0 * pow({z}, 3)) "
            f"+ 1.0 / (1260.0 * pow({z}, 5)) - ln({product}))")


def _series(a: str, x: str) -> str:
    """sum of x^n / (a (a + 1) ... (a + n))."""
    return (f"aggregate(sequence(1, {STEPS}), named_struct('t', 1.0D / {a}, 's', 1.0D / {a}), "
            f"(acc, i) -> named_struct('t', acc.t * {x} / ({a} + i), 's', acc.s + acc.t * {x} / ({a} + i)), acc -> acc.s)")


def _fraction(a: str, x: str) -> str:
    """Legendre's continued fraction by Lentz's method; for x >= a + 1 no denominator vanishes."""
    b = f"({x} + 1.0D - {a} + 2.0D * i)"
    an = f"(i * ({a} - i))"
    d = f"(1.0D / ({an} * acc.d + {b}))"
    c = f"({b} + {an} / acc.c)"
    first = f"(1.0D / ({x} + 1.0D - {a}))"
    return (f"aggregate(sequence(1, {STEPS}), named_struct('c', 1.0D / 1e-300D, 'd', {first}, 'h', {first}), "
            f"(acc, i) -> named_struct('c', {c}, 'd', {d}, 'h', acc.h * {d} * {c}), acc -> acc.h)")


def _uniform(a: str, x: str) -> str:
    """Temme's expansion: half an erfc of the transformed distance from a, and two correction terms."""
    half_square = ("(CASE WHEN abs(m) < 0.01 THEN m * m * (0.5D - m / 3.0D + pow(m, 2) / 4.0D - pow(m, 3) / 5.0D + pow(m, 4) / 6.0D) "
                   "ELSE m - log1p(m) END)")
    c0 = ("(CASE WHEN abs(m) < 0.05 THEN -1.0D / 3.0D + eta / 12.0D - 2.0D * pow(eta, 2) / 135.0D + pow(eta, 3) / 864.0D + pow(eta, 4) / 2835.0D "
          "ELSE 1.0D / m - 1.0D / eta END)")
    c1 = "(-1.0D / 540.0D - eta / 288.0D + pow(eta, 2) / 378.0D)"
    last = f"(0.5D * {let('z', f'eta * sqrt({a} / 2.0D)', erfc_sql('z'))} + exp(-{a} * half) / sqrt(2.0D * pi() * {a}) * ({c0} + {c1} / {a}))"
    return let("m", f"({x} - {a}) / {a}", let("half", half_square, let("eta", "sign(m) * sqrt(2.0D * half)", last)))


def gamma_q_sql(a: str, x: str) -> str:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0, in constant time for every a.

    The series below a + 1, the continued fraction above it; the uniform expansion for a large a.
    """
    head = f"exp(ga * ln(gx) - gx - {log_gamma_sql('ga')})"
    body = (f"(CASE WHEN gx <= 0 THEN 1.0D WHEN ga > {LARGE_A}D THEN least(1.0D, greatest(0.0D, {_uniform('ga', 'gx')})) "
            f"WHEN gx < ga + 1.0D THEN greatest(0.0D, 1.0D - {head} * {_series('ga', 'gx')}) ELSE least(1.0D, {head} * {_fraction('ga', 'gx')}) END)")
    return let("ga", a, let("gx", x, body))


def chi2_sf_sql(stat: str, dof: str) -> str:
    """P(chi-square with ``dof`` degrees of freedom > ``stat``)."""
    return f"(CASE WHEN {dof} <= 0 OR {stat} <= 0 THEN 1.0D ELSE {gamma_q_sql(f'(CAST({dof} AS DOUBLE) / 2.0D)', f'({stat} / 2.0D)')} END)"
