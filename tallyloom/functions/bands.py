"""Levels of success rates. Three vocabularies with thresholds of their own: analysis, early reports, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: thresholds and texts of each vocabulary, from the highest level down
ANALYSIS = [
    (0.85, "Beklenen düzeyin üzerinde gelişmiş", "Öğrenme çıktısına ilişkin kanıtlar beklenen düzeyin üzerinde gelişim göstermektedir."),
    (0.70, "Beklenen düzeyde gelişmiş", "Öğrenme çıktısına ilişkin kanıtlar beklenen düzeydedir; gelişim izlenmelidir."),
    (0.50, "Gelişimi sürmekte", "Öğrenme çıktısının gerçekleşme düzeyini geliştirecek öğrenme yaşantılarına ihtiyaç vardır."),
    (None, "İlave destek gerektiriyor", "Öğrenme çıktısına ilişkin öğrenme kanıtları ilave desteğe ihtiyaç olduğunu göstermektedir."),
]
EARLY = [
    (0.80, "Güçlü", "Öğrenme çıktısında güçlü yeterlilik düzeyi tespit edilmiştir."),
    (0.50, "Geliştirilmeli", "Öğrenme çıktısında gelişim ihtiyacı bulunduğu tespit edilmiştir."),
    (None, "Kritik", "Öğrenme çıktısında öncelikli gelişim ihtiyacı bulunduğu tespit edilmiştir."),
]
DISPLAY = [(0.85, "Beklenen düzeyin üzerinde"), (0.70, "Beklenen düzeyde"), (0.50, "Gelişimi sürmekte"), (None, "Gelişim desteği öncelikli")]
#: Rates below it are weak, and below CRITICAL critical.
WEAK, CRITICAL = 0.70, 0.50


def _pick(rate: Column, steps: list[tuple], at: int) -> Column:
    out = F.lit(steps[-1][at])
    for step in reversed(steps[:-1]):
        out = F.when(rate >= step[0], F.lit(step[at])).otherwise(out)
    return F.when(rate.isNotNull(), out)


def level(rate: Column) -> Column:
    return _pick(rate, ANALYSIS, 1)


def decision(rate: Column) -> Column:
    return _pick(rate, ANALYSIS, 2)


def early_level(rate: Column) -> Column:
    return _pick(rate, EARLY, 1)


def early_decision(rate: Column) -> Column:
    return _pick(rate, EARLY, 2)


def display_level(rate: Column) -> Column:
    return _pick(rate, DISPLAY, 1)


def severity(rate: Column) -> Column:
    return F.when(rate < CRITICAL, "critical").when(rate.isNotNull(), "medium")
