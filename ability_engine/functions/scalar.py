"""Scalar maths as Column builders: logits, ratings, the normal and log-normal laws. All stay in generated code; the last ones are the same forms on arrays, for steps
whose generated code would be longer than the JVM compiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = (0.5, 99.5)
#: Points of the rating scale for a tenfold gain in odds, and the rating of ability 0.
RATING_STEP, RATING_BASE = 400.0, 1000.0
#: Numerator and denominator of G. West's double-precision rational form of the normal tail (2005), highest power first.
TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Wichura's AS 241 rational forms of the normal quantile, as (numerator, denominator) of centre, middle and far tail.
QUANTILE = (
    ((2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080),
     (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)),
    ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
     (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0)),
    ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
     (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)),
)


def _col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def horner(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + F.lit(f)
    return out


def clamp(x, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def logit(p) -> Column:
    return F.ln(_col(p) / (1 - _col(p)))


def index_of(theta) -> Column:
    """Ability as a percentage."""
    return 100 * sigmoid(theta)


def theta_of(index) -> Column:
    """Ability of a percentage, which is clipped first."""
    return logit(clamp(index, *CLIP) / 100)


def rating_of(theta) -> Column:
    return RATING_BASE + RATING_STEP / math.log(10) * _col(theta)


def theta_of_rating(rating) -> Column:
    return (_col(rating) - RATING_BASE) * (math.log(10) / RATING_STEP)


def rating_of_index(index) -> Column:
    return rating_of(theta_of(index))


def probability_of(value, unit=None, elo_reference=None) -> Column:
    """A score as a clipped probability: a percentage, or the expected result against the reference of an Elo scale."""
    share = clamp(value, *CLIP) / 100
    if unit is None:
        return share
    elo = 1 / (1 + F.pow(F.lit(10.0), (_col(elo_reference) - _col(value)) / 400))
    missing = F.raise_error(F.lit("an Elo benchmark needs a reference")).cast("double")
    return F.when(_col(unit) == "elo", F.when(_col(elo_reference).isNull(), missing).otherwise(clamp(elo, CLIP[0] / 100, CLIP[1] / 100))).otherwise(share)


def normal_pdf(x) -> Column:
    return F.exp(-_col(x) * _col(x) / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x) -> Column:
    x = _col(x)
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * horner(z, TAIL_TOP) / horner(z, TAIL_BOTTOM)
    far = z + 0.65
    for k in (4, 3, 2, 1):
        far = z + k / far
    tail = F.when(F.isnan(x), x).when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(e / far / math.sqrt(2 * math.pi))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_quantile(p) -> Column:
    p = _col(p)
    q = p - 0.5
    r = 0.180625 - q * q
    centre = q * horner(r, QUANTILE[0][0]) / horner(r, QUANTILE[0][1])
    t = F.sqrt(-F.ln(F.least(p, 1 - p)))
    near = horner(t - 1.6, QUANTILE[1][0]) / horner(t - 1.6, QUANTILE[1][1])
    far = horner(t - 5, QUANTILE[2][0]) / horner(t - 5, QUANTILE[2][1])
    tail = F.when(t <= 5, near).otherwise(far)
    inside = F.when(F.abs(q) <= 0.425, centre).when(q < 0, -tail).otherwise(tail)
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).otherwise(inside)


def lognormal_cdf(mu, sigma, t) -> Column:
    """0 up to t = 0; a point mass at exp(mu) if sigma isn't positive."""
    mu, sigma, t = _col(mu), _col(sigma), _col(t)
    safe = F.when(t > 0, F.ln(t))
    mass = F.when(safe >= mu, 1.0).otherwise(0.0)
    return F.when(t <= 0, 0.0).when(sigma <= 0, mass).otherwise(normal_cdf((safe - mu) / sigma))


def lognormal_quantile(mu, sigma, q) -> Column:
    """exp(mu) if sigma isn't positive, before all else; 0 and infinity at the ends."""
    mu, sigma, q = _col(mu), _col(sigma), _col(q)
    inside = F.exp(mu + sigma * normal_quantile(q))
    return F.when(sigma <= 0, F.exp(mu)).when(q <= 0, 0.0).when(q >= 1, F.lit(float("inf"))).otherwise(inside)


def recency_weight(age, half_life: float) -> Column:
    return F.lit(1.0) if not (0 < half_life < math.inf) else F.pow(F.lit(0.5), _col(age) / half_life)


def rounded_date(date: Column, days: Column) -> Column:
    """``date`` moved by ``days``, halves rounded up."""
    return F.date_add(date, F.floor(days + 0.5).cast("int"))


def normal_cdf_array(x: np.ndarray) -> np.ndarray:
    """``normal_cdf`` of an array, by the same forms."""
    z = np.abs(x)
    e = np.exp(-z * z / 2)
    far = z + 0.65
    for k in (4, 3, 2, 1):
        far = z + k / far
    tail = np.where(z > 37, 0.0, np.where(z < 7.07106781186547, e * np.polyval(TAIL_TOP, z) / np.polyval(TAIL_BOTTOM, z), e / far / math.sqrt(2 * math.pi)))
    return np.where(x > 0, 1 - tail, np.where(np.isnan(x), x, tail))


def lognormal_cdf_array(mu: np.ndarray, sigma: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``lognormal_cdf`` of arrays that broadcast."""
    log = np.log(np.where(t > 0, t, 1.0))
    spread = np.where(sigma > 0, sigma, 1.0)
    return np.where(t <= 0, 0.0, np.where(sigma <= 0, (log >= mu) * 1.0, normal_cdf_array((log - mu) / spread)))


def normal_quantile_array(p: np.ndarray) -> np.ndarray:
    """``normal_quantile`` of an array, by the same forms."""
    q = p - 0.5
    inner = np.where((p > 0) & (p < 1), p, 0.5)
    t = np.sqrt(-np.log(np.minimum(inner, 1 - inner)))
    centre, near, far = (np.polyval(top, x) / np.polyval(bottom, x) for (top, bottom), x in zip(QUANTILE, (0.180625 - q * q, t - 1.6, t - 5), strict=True))
    tail = np.where(t <= 5, near, far)
    inside = np.where(np.abs(q) <= 0.425, q * centre, np.where(q < 0, -tail, tail))
    return np.where(np.isnan(p), p, np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, inside)))
