"""Queries of whole-series methods."""

from pyspark.sql import functions as F

from barloom.operators import returns as R
from barloom.operators import series as S
from barloom.registry import case
from barloom.registry import tables as X


def _log(s, sf):
    return X.px(s, sf).withColumn("lp", F.ln("close"))


@case("win19_adf_test")
def _(s, sf):
    return S.adf_test(_log(s, sf), "lp")


@case("win20_find_min_d")
def _(s, sf):
    return S.find_min_d(_log(s, sf), "lp", step=0.25, threshold=0.01)


@case("win21_wavelet_denoise")
def _(s, sf):
    return S.wavelet_denoise(_log(s, sf), "lp").select("symbol", "date", "denoised")


@case("win22_causal_wavelet_denoise")
def _(s, sf):
    return S.denoised_returns(X.px(s, sf), "close").select("symbol", "date", "denoised_return")


@case("win31_garch_fit")
def _(s, sf):
    d = R.log_return(X.px(s, sf), out="ret").withColumns({
        "fold": F.lit(0), "role": F.when(F.year("date") < 2000, "train").otherwise("test")})
    return S.garch_forecast(d, S.garch_fit(d, "ret"), "ret").select("symbol", "date", "forecast")
