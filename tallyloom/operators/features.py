"""Row features of the tutoring log: ratios, flag sums, focus state, session position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.expr import (
    finite_or_null, flag, null_safe_sum, plain_sum, safe_div,
)
from tallyloom.functions.scale import join_small

EPSILON = 1e-6

# Input columns of the operation and expert sums.
BASIC_OPERATIONS = ["eq_AD", "eq_SB", "eq_MT", "eq_DV"]
FRACTION_OPERATIONS = ["eq_AF", "eq_MF"]
ADVANCED_OPERATIONS = ["eq_DM", "eq_MM", "eq_OI", "eq_SP"]
CLIP_BASIC = ["eq_MT_fator_clip"]
CLIP_ADVANCED = ["eq_OI_fator_clip"]
DAILY_BASIC = ["misc_EqPrim_Ad_Sin_diario", "misc_EqPrim_Dv_Sin_diario", "eq_SB_erro_diario"]
DAILY_ADVANCED = [
    "eq_MM_acerto_diario", "eq_DM_erro_diario", "eq_DM_fator_diario", "eq_MM_fator_diario",
    "misc_OI_Dv_Plus_Dv_Minus_diario", "misc_OI_Dv_Plus_Dv_Plus_diario",
    "misc_OI_Dv_Minus_Dv_Plus_diario"]
TOTAL_BASIC = ["misc_EqPrim_Ad_Inc_total", "misc_EqPrim_Dv_Inc_total"]
TOTAL_FRACTION = ["eq_AF_acerto_total", "eq_AF_fator_total", "eq_MF_fator_total"]
TOTAL_ADVANCED = [
    "eq_DM_erro_total", "eq_MM_fator_total", "eq_SP", "misc_OI_Dv_Plus_Dv_Minus_total",
    "misc_OI_Mt_Minus_Ad_total", "misc_OI_Dv_Plus_Dv_Plus_total", "misc_OI_Mt_Plus_Ad_total",
    "misc_OI_Dv_Minus_Dv_Plus_total", "misc_OI_Mt_Plus_Sb_total", "misc_OI_Dv_Plus_Sb_total"]


@dataclass(frozen=True)
class Feature:
    """A named Column with the columns it reads; ``consume`` lists those dropped afterwards."""
    name: str
    inputs: list[str]
    value: Column
    consume: bool = True


def add_features(df: DataFrame, features: list[Feature], replace: bool = True) -> DataFrame:
    """Adds all features in one projection, then drops the consumed inputs.

    Inputs are dropped only after every feature is made, so several features may read one column.
    """
    wanted = {c for f in features for c in f.inputs}
    missing = sorted(wanted - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = df.withColumns({f.name: f.value for f in features})
    made = {f.name for f in features}
    spent = {c for f in features if f.consume for c in f.inputs} - made
    return out.drop(*spent) if replace else out


def relative_velocity() -> Feature:
    return Feature("velocidade_relativa_equacao", ["tempo_equacao", "tempo_medio_eq_diario"],
                   safe_div("tempo_equacao", F.col("tempo_medio_eq_diario") + EPSILON))


def verified() -> Feature:
    return Feature("verified", ["verificado_com_mouse", "verificado_com_teclado"],
                   F.col("verificado_com_mouse").bitwiseOR(F.col("verificado_com_teclado")))


def equation_accuracy() -> Feature:
    return Feature("accuracy_eq", ["num_passos_corretos_eq", "num_passos_equacao"],
                   safe_div("num_passos_corretos_eq", F.col("num_passos_equacao") + 1))


def click_ratio() -> Feature:
    return Feature("click_ratio", ["num_click_passo", "num_click_acumulado"],
                   safe_div("num_click_passo", F.col("num_click_acumulado") + 1))


def operation_groups() -> list[Feature]:
    """Counts of basic, fraction and advanced operations; a null flag makes the count null."""
    return [Feature("basic_operations", BASIC_OPERATIONS, plain_sum(BASIC_OPERATIONS)),
            Feature("fraction_operations", FRACTION_OPERATIONS, plain_sum(FRACTION_OPERATIONS)),
            Feature("advanced_operations", ADVANCED_OPERATIONS, plain_sum(ADVANCED_OPERATIONS))]


def _expert(name: str, cols: list[str]) -> Feature:
    return Feature(name, cols, null_safe_sum(cols))


def clip_expert_sums() -> list[Feature]:
    return [_expert("clip_basic_expert", CLIP_BASIC),
            _expert("clip_advanced_expert", CLIP_ADVANCED)]


def daily_expert_sums() -> list[Feature]:
    return [_expert("diario_basic_expert", DAILY_BASIC),
            _expert("diario_advanced_expert", DAILY_ADVANCED)]


def total_expert_sums() -> list[Feature]:
    return [_expert("total_basic_expert", TOTAL_BASIC),
            _expert("total_fraction_expert", TOTAL_FRACTION),
            _expert("total_advanced_expert", TOTAL_ADVANCED)]


def window_active() -> Feature:
    """0 on losing or leaving the window, else 1 on gaining or entering it, else 0."""
    lost = flag((F.col("type_window_lost_focus") == 1) | (F.col("type_left_window") == 1)) == 1
    got = flag((F.col("type_window_gained_focus") == 1) | (F.col("type_entered_window") == 1)) == 1
    return Feature("window_active",
                   ["type_window_gained_focus", "type_entered_window",
                    "type_window_lost_focus", "type_left_window"],
                   F.when(lost, 0).when(got, 1).otherwise(0))


def engagement_index() -> Feature:
    return Feature("engagement_index", ["tempo_equacao", "idle_time_acumulado"],
                   safe_div("tempo_equacao",
                            F.col("tempo_equacao") + F.col("idle_time_acumulado") + EPSILON))


def class_performance_delta() -> list[Feature]:
    """Own value minus the class mean; reads ``accuracy_eq``, so add that feature first."""
    return [Feature("delta_tempo_eq", ["tempo_medio_eq_diario", "tempo_medio_eq_diario_turma"],
                    F.col("tempo_medio_eq_diario") - F.col("tempo_medio_eq_diario_turma")),
            Feature("delta_accuracy", ["accuracy_eq", "media_efetividade_passos_eq_turma"],
                    F.col("accuracy_eq") - F.col("media_efetividade_passos_eq_turma"))]


def time_efficiency() -> list[Feature]:
    return [Feature("time_vs_mean", ["tempo_equacao", "tempo_medio_eq_diario"],
                    safe_div("tempo_equacao", "tempo_medio_eq_diario"), consume=False),
            Feature("step_efficiency", ["tempo_passo", "tempo_medio_passo_diario"],
                    safe_div("tempo_passo", "tempo_medio_passo_diario"), consume=False),
            Feature("relative_idle_time", ["idle_time_acumulado", "tempo_equacao"],
                    safe_div("idle_time_acumulado", "tempo_equacao"), consume=False)]


def equation_progress() -> list[Feature]:
    return [Feature("progress_effectiveness", ["num_passos_corretos_eq", "num_passos_equacao"],
                    safe_div("num_passos_corretos_eq", "num_passos_equacao"), consume=False),
            Feature("error_rate", ["efetividade_passos_eq"],
                    F.lit(1.0) - F.col("efetividade_passos_eq"), consume=False)]


def step_verifications(literal: str = "step_verification") -> Feature:
    return Feature("step_verifications", ["log_type"], flag(F.col("log_type") == literal),
                   consume=False)


def session_position(df: DataFrame, day: str = "num_dia", seq: str = "num_log",
                     name: str = "session_position") -> DataFrame:
    """(day - 1) + seq / largest seq of that day over all users.

    A day can hold most of the rows, so the maximum is aggregated (map-side first) and joined
    back as a counted small table instead of windowed by day.
    """
    top = df.where(F.col(day).isNotNull()).groupBy(day).agg(F.max(seq).alias("_top"))
    return (join_small(df, top, [day])
            .withColumn(name, F.col(day) - 1 + safe_div(seq, "_top")).drop("_top"))


def clean_numeric(df: DataFrame, bound: float = 1e308, keep: list[str] | None = None) -> DataFrame:
    """Every numeric column as double: infinities to null, the rest clipped to +-bound."""
    skip = set(keep or [])
    return df.select(*[
        finite_or_null(f.name, bound).alias(f.name)
        if isinstance(f.dataType, T.NumericType) and f.name not in skip else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def engineer_behavior(df: DataFrame, replace: bool = True) -> DataFrame:
    """All behaviour features in one projection (inputs dropped at the end) plus session position."""
    features = [relative_velocity(), verified(), equation_accuracy(), click_ratio(),
                *operation_groups(), *clip_expert_sums(), *daily_expert_sums(),
                *total_expert_sums(), window_active(), engagement_index()]
    return session_position(add_features(df, features, replace))
