"""The normal distribution as SQL text, valid in Spark and other engines."""

from __future__ import annotations

# Hart's rational approximation of the normal CDF (double precision).
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(values: tuple[float, ...], x: str) -> str:
    out = f"{values[0]:.15e}"
    for v in values[1:]:
        out = f"({out} * {x} + {v:.15e})"
    return out


def upper_tail(a: str) -> str:
    """SQL of the probability that a standard normal variable exceeds ``a``, which is not negative."""
    return (
        f"CASE WHEN {a} > 37 THEN CAST(0 AS DOUBLE) WHEN {a} < 7.07106781186547e0 THEN exp(-{a} * {a} / 2) * {_horner(_TOP, a)} / {_horner(_LOW, a)}"
        f" ELSE exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 6.5e-1))))) / 2.506628274631e0 END"
    )


def normal_cdf(z: str) -> str:
    """SQL of the probability that a standard normal variable is at most ``z``."""
    tail = upper_tail(f"abs({z})")
    return f"(CASE WHEN {z} > 0 THEN 1 - ({tail}) ELSE ({tail}) END)"


# Wichura's rational approximations of the normal quantile (AS 241), by region: numerator, denominator.
_QUANTILE = (
    ((2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
     (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)),
    ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
     (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)),
    ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
     (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)),
)


def normal_quantile(p: str) -> str:
    """SQL of the value below which a standard normal variable lies with probability ``p`` (null outside 0 and 1)."""
    q = f"({p} - 5e-1)"
    r = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN {p} ELSE 1 - {p} END))"
    (a, b), (c, d), (e, f) = _QUANTILE
    middle = f"(1.80625e-1 - {q} * {q})"
    inner = f"{q} * {_horner(a, middle)} / {_horner(b, middle)}"
    tail = f"CASE WHEN {r} <= 5 THEN {_horner(c, f'({r} - 1.6e0)')} / {_horner(d, f'({r} - 1.6e0)')} ELSE {_horner(e, f'({r} - 5)')} / {_horner(f, f'({r} - 5)')} END"
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({q}) <= 4.25e-1 THEN {inner} ELSE (CASE WHEN {q} < 0 THEN -1 ELSE 1 END) * ({tail}) END END)"


def synchronicity(mu0: str = "mu0", mu: str = "mu", sigma: str = "sigma") -> str:
    """SQL of s in [-1, 1]: how far the truth lies from the prediction, signed by the side it lies on.

    Both sides are twice the tail beyond the distance in deviations, which is so stated once.
    """
    return f"((CASE WHEN {mu0} > {mu} THEN 2 ELSE -2 END) * ({upper_tail(f'(abs({mu0} - {mu}) / ({sigma} + 1e-6))')}))"
