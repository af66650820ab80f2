"""Capture degradation: named conditions and the effects that need no image library (D-cfg, D-photo, D-moire)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values. Amplitudes by condition; what a condition does not name has no effect.
DEFAULTS = {"perspective": 0.0, "shake_px": 0.0, "rotation_deg": 0.0, "zoom": 1.0, "gamma": 1.0, "exposure": 1.0, "wb_b": 1.0, "wb_g": 1.0, "wb_r": 1.0, "contrast": 1.0, "vignette": 0.0, "blur_sigma": 0.0, "motion_blur_px": 0, "noise_sigma": 0.0, "moire": 0.0, "resample": 1.0, "jpeg_quality": 100}
CONDITIONS = {
    "clean": {},
    "mild": {"perspective": 0.01, "shake_px": 0.5, "rotation_deg": 0.5, "zoom": 0.98, "gamma": 1.05, "exposure": 1.03, "wb_b": 1.02, "wb_r": 0.98, "contrast": 0.98, "blur_sigma": 0.6, "noise_sigma": 2.0, "resample": 0.9, "jpeg_quality": 90},
    "moderate": {"perspective": 0.035, "shake_px": 1.5, "rotation_deg": 1.5, "zoom": 0.92, "gamma": 1.25, "exposure": 0.9, "wb_b": 1.08, "wb_r": 0.9, "contrast": 0.9, "vignette": 0.2, "blur_sigma": 1.2, "motion_blur_px": 3, "noise_sigma": 5.0, "moire": 0.06, "resample": 0.72, "jpeg_quality": 70},
    "severe": {"perspective": 0.075, "shake_px": 3.0, "rotation_deg": 4.0, "zoom": 0.82, "gamma": 1.6, "exposure": 0.72, "wb_b": 1.18, "wb_r": 0.82, "contrast": 0.78, "vignette": 0.38, "blur_sigma": 2.2, "motion_blur_px": 7, "noise_sigma": 10.0, "moire": 0.14, "resample": 0.5, "jpeg_quality": 45},
    "perspective_only": {"perspective": 0.075, "rotation_deg": 4.0, "zoom": 0.82},
    "blur_only": {"blur_sigma": 2.2, "motion_blur_px": 7},
    "exposure_only": {"gamma": 1.6, "exposure": 0.72, "wb_b": 1.18, "wb_r": 0.82, "contrast": 0.78, "vignette": 0.38},
    "compression_only": {"jpeg_quality": 30},
    "moire_only": {"moire": 0.14, "resample": 0.5},
    "noise_only": {"noise_sigma": 12.0},
    "extreme": {"perspective": 0.11, "shake_px": 5.0, "rotation_deg": 7.0, "zoom": 0.7, "gamma": 2.0, "exposure": 0.6, "wb_b": 1.3, "wb_r": 0.72, "contrast": 0.65, "vignette": 0.5, "blur_sigma": 3.0, "motion_blur_px": 11, "noise_sigma": 16.0, "moire": 0.2, "resample": 0.4, "jpeg_quality": 30},
}


def condition(name: str, **overrides) -> dict:
    """One condition with defaults filled in; a name that is none of them is a KeyError."""
    return {**DEFAULTS, **CONDITIONS[name], **overrides}


def conditions(spark: SparkSession) -> DataFrame:
    """D-cfg: all conditions, one row each."""
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in DEFAULTS.items())
    return spark.createDataFrame([(name, *condition(name).values()) for name in CONDITIONS], f"name string, {kinds}")


def photometric(b: Column, g: Column, r: Column, y: Column, x: Column, width: int, height: int, cfg: dict) -> list[Column]:
    """D-photo: gamma, exposure, white balance, contrast, vignette; clipped and truncated to integers (B, G, R)."""
    radius = F.sqrt(F.pow((x - width / 2) / (width / 2), 2) + F.pow((y - height / 2) / (height / 2), 2))
    shade = 1.0 - cfg["vignette"] * F.pow(F.least(F.lit(1.0), radius / F.sqrt(F.lit(2.0))), 2)
    out = []
    for value, gain in ((b, cfg["wb_b"]), (g, cfg["wb_g"]), (r, cfg["wb_r"])):
        v = F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / 255.0)), cfg["gamma"]) * cfg["exposure"] * gain
        if cfg["contrast"] != 1.0:  # at 1.0 the detour would lose the last bit, and truncation a whole step
            v = (v - 0.5) * cfg["contrast"] + 0.5
        out.append(F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v * shade * 255.0))).cast("int"))
    return out


def moire(value: Column, y: Column, x: Column, amplitude: float, theta: Column, frequency: Column) -> Column:
    """D-moire: two gratings near the sampling limit, multiplied in; clipped and truncated."""
    u, v = x * F.cos(theta) + y * F.sin(theta), y * F.cos(theta) - x * F.sin(theta)
    pattern = F.sin(2 * F.pi() * frequency * u) * F.sin(2 * F.pi() * frequency * 0.97 * v)
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), value * (1.0 + amplitude * pattern)))).cast("int")
