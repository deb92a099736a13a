"""Column functions of a scored forecast: bands, direction, book, trade, fees, return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Band edges, margins and thresholds of the scoring contract.
PRICE_BANDS = [(".05-.25", 0.05, 0.25), (".25-.5", 0.25, 0.5), (".5-.75", 0.5, 0.75), (".75-.95", 0.75, 0.95)]
HORIZON_BANDS = [("<1d", 0.0, 1.0), ("1-3d", 1.0, 3.0), ("3-7d", 3.0, 7.0), (">7d", 7.0, None)]
LIVE_SPREAD = 0.10
WIDE_SPREAD = 0.5
PROBE_MARGIN, MARKET_MARGIN = 0.10, 0.30
DISAGREE, DRIFT = 0.10, 0.02
EPS = 1e-9


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ``|``; the same in every engine."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def r6(x: Column) -> Column:
    return F.round(x, 6)


def band_of(q: Column) -> Column:
    """Closed price bands; a shared edge belongs to the lower band."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(PRICE_BANDS):
        out = F.when(q.between(low, high), name).otherwise(out)
    return out


def horizon_band(days: Column) -> Column:
    """Half-open bands of days to settlement."""
    out = F.lit(None).cast("string")
    for name, low, high in HORIZON_BANDS:
        out = F.when((days >= low) & ((days < high) if high else F.lit(True)), name).otherwise(out)
    return out


def late_horizon_band(days: Column) -> Column:
    """The right-closed variant: up to 1, 3, 7 and 30 days, and more."""
    return F.when(days <= 1, "<=1").when(days <= 3, "<=3").when(days <= 7, "<=7").when(days <= 30, "<=30").otherwise(">30")


def price_class(q: Column) -> Column:
    return F.when(q < 1 / 3, "lo").when(q < 2 / 3, "mid").otherwise("hi")


def gap_bin(gap: Column) -> Column:
    """Bins of |p - q| by tenths from .05, with all from .5 in the last; null below."""
    return F.when(gap >= 0.5, "0.5+").when(gap >= 0.4, ".4").when(gap >= 0.3, ".3").when(gap >= 0.2, ".2").when(gap >= 0.1, ".1").when(gap >= 0.05, ".05")


def direction(p: Column, q: Column) -> Column:
    """Whether a forecast leans further the market's way or against it."""
    return F.when((q == 0.5) | (p == q), "no lean").when((p > q) == (q > 0.5), "with").otherwise("against")


def wrong_side(p: Column, y: Column) -> Column:
    """1 if p and y lie on different sides of a half, which counts as Yes."""
    return ((p >= 0.5) != (y >= 0.5)).cast("double")


def book_status(bid: Column, ask: Column, one_sided: Column) -> Column:
    return F.when(one_sided | bid.isNull() | ask.isNull(), "one_sided_book").when((ask <= bid) | (ask - bid > WIDE_SPREAD), "degenerate_book").otherwise("ok")


def round_up_cent(x: Column) -> Column:
    return F.ceil(F.bround(x * 100, 9)) / F.lit(100.0)


def fee_per_share(rate: Column, price: Column, enabled: Column | None = None, exponent: Column | None = None) -> Column:
    """Taker fee of a share; 0 where fees are off, exponent 1 where there is none."""
    base = price * (1 - price)
    fee = rate * (base if exponent is None else F.when(F.coalesce(exponent, F.lit(1.0)) == 1, base).otherwise(F.pow(base, exponent)))
    return fee if enabled is None else F.when(F.coalesce(enabled, F.lit(False)), F.coalesce(fee, F.lit(0.0))).otherwise(0.0)


def trade_reason(p: Column, bid: Column, ask: Column, status: Column) -> Column:
    return F.when(status != "ok", status).when((p > ask) | (p < bid), "traded").otherwise("inside_spread")


def trade_side(p: Column, bid: Column, ask: Column, status: Column | None = None) -> Column:
    """Buy Yes above the ask, No below the bid; one-sided and degenerate books are never traded."""
    fits = F.lit(True) if status is None else status == "ok"
    return F.when(fits & (p > ask), "Yes").when(fits & (p < bid), "No")


def buy_return(price: Column, won: Column, fee: Column, round_fee: Column, stake: float = 1.0) -> Column:
    """Return on an order of ``stake``: stake / (price + fee) shares; the order's fee is rounded up to a cent where asked."""
    shares = F.try_divide(F.lit(float(stake)), price + fee)
    paid = shares * fee
    outlay = shares * price + F.when(round_fee, round_up_cent(paid)).otherwise(paid)
    return F.try_divide(F.when(won, shares).otherwise(0.0), outlay) - 1


def quarantined(p: Column, q: Column, y: Column) -> Column:
    """Confidently right without news, where the market did not know."""
    return (F.abs(p - y) <= PROBE_MARGIN + EPS) & (F.abs(q - y) >= MARKET_MARGIN - EPS)


def logit(p: Column, clip: float = 1e-4) -> Column:
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
