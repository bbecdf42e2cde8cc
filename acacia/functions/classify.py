"""Classification ladders; the comparison at each step is part of the meaning.

The limits, scores and labels in this module are fixed values: results have to follow them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first step whose limit the value stays below."""
    out = F.lit(last)
    for limit, label in reversed(steps):
        out = F.when(value < limit, label).otherwise(out)
    return out


def segment_movement(speed) -> Column:
    return F.when(_c(speed) < 8, "foot").when(_c(speed) <= 120, "vehicle").otherwise("aircraft")


#: Speed category by km/h.
SPEEDS = [(1, "stationary"), (3, "slow_patrol"), (6, "fast_patrol"), (30, "slow_vehicle"), (80, "fast_vehicle"), (150, "low_altitude")]


def speed_category(speed) -> Column:
    return ladder(_c(speed), SPEEDS, "high_altitude")


def analysis_movement(speed) -> Column:
    return ladder(_c(speed), [(6, "foot"), (80, "vehicle")], "aircraft")


#: What a speed category adds to the quality score.
CATEGORY_SCORE = {"slow_patrol": 30, "fast_patrol": 20, "slow_vehicle": 15, "fast_vehicle": 5, "low_altitude": 20, "high_altitude": -10}


def quality_score(category, sinuosity, straight, circles) -> Column:
    category, sinuosity, circles = map(_c, (category, sinuosity, circles))
    speed = F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORY_SCORE.items() for x in kv])[category], F.lit(0))
    path = F.when(sinuosity > 2.0, 15).when(sinuosity > 1.5, 10).when(_c(straight), -15).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.lit(50) + speed + path + 3 * circles).cast("double")))


def quality_label(score) -> Column:
    return F.when(_c(score) >= 80, "excellent").when(_c(score) >= 60, "good").when(_c(score) >= 40, "moderate").otherwise("poor")


def coverage_intensity(dry_months, rainy_months, coverage_percent, distance_km) -> Column:
    """Months of six dry ones, rainy ones at three tenths; else coverage or distance of 80; at most 1.5."""
    dry, rainy, coverage, distance = map(_c, (dry_months, rainy_months, coverage_percent, distance_km))
    months = (dry.cast("double") + rainy.cast("double") * 0.3) / 6.0
    return F.least(F.lit(1.5), F.when((dry > 0) | (rainy > 0), months).when(coverage > 0, coverage / 80.0).otherwise(distance / 80.0))


def trajectory_type(nodes, speed, spread, net_south) -> Column:
    nodes, speed, spread, south = map(_c, (nodes, speed, spread, net_south))
    return (
        F.when(nodes < 3, "unknown")
        .when(speed > 30, "management_fast")
        .when((speed > 15) & (spread > 30), "management_vehicle")
        .when(speed > 15, "herder_fast")
        .when((speed > 5) & (south > 20), "transhumance")
        .when(speed > 5, "herder_local")
        .when((speed > 2) & (nodes > 10) & (south > 15), "transhumance_slow")
        .when(speed > 2, "local_burning")
        .when(nodes > 7, "village_persistent")
        .otherwise("local_stationary")
    )


def outcome_by_index(last_inside, last) -> Column:
    return F.when(_c(last_inside) == _c(last), "STOPPED_INSIDE").otherwise("TRANSITED")


def outcome_three_way(nodes_after, outside_after) -> Column:
    return F.when(_c(nodes_after) == 0, "STOPPED_INSIDE").when(_c(outside_after) > 0, "TRANSITED").otherwise("STOPPED_AFTER_EXIT")


def outcome_by_date(last_inside_date, last_date) -> Column:
    return F.when(_c(last_inside_date) < _c(last_date), "TRANSITED").otherwise("STOPPED_INSIDE")


def spread_pattern(clusters, lat_span, lon_span, stored, default) -> Column:
    """Pattern of a year's loss clusters by how they are spread, in degrees."""
    n, tall, wide = map(_c, (clusters, lat_span, lon_span))
    flat = (tall <= 0) | (wide <= 0)
    aspect = F.when(flat, F.lit(0.0)).otherwise(F.greatest(tall, wide) / F.when(flat, F.lit(1.0)).otherwise(F.least(tall, wide)))
    density = F.when(flat, F.lit(0.0)).otherwise(n / F.when(flat, F.lit(1.0)).otherwise(tall * wide * 111 * 111))
    return F.when(n == 0, _c(default)).when(n == 1, "cluster").when(aspect > 3, "strip").when(density > 0.5, "cluster").when(n > 5, "scattered").otherwise(F.coalesce(_c(stored), _c(default)))


def component_pattern(aspect, fill, pixels, fast: bool = False) -> Column:
    compact = (_c(fill) > (0.4 if fast else 0.5)) & (_c(pixels) > 100)
    return F.when(_c(aspect) > 5, "strip").when(compact, "cluster").otherwise("scattered")


def loss_event(area_km2) -> Column:
    return F.when(_c(area_km2) > 10, "major").when(_c(area_km2) > 1, "moderate").otherwise("minor")


def settlement_size(area_m2) -> Column:
    return ladder(_c(area_m2), [(200, "temporary"), (1000, "small"), (5000, "medium")], "large")


HOUSEHOLD, HOUSE_M2 = 5.2, 50.0


def population(pixel_population, pixels, area_m2) -> Column:
    """Population grid if it has any, else houses of 50 m2."""
    by_grid = _c(pixel_population) * _c(pixels)
    return F.round(F.when(_c(pixel_population) > 0, by_grid).otherwise(_c(area_m2) / HOUSE_M2 * HOUSEHOLD), 0).cast("long")


def households(people) -> Column:
    return F.round(_c(people) / HOUSEHOLD, 0).cast("long")


def conflict_risk(settlements, density) -> Column:
    n, d = _c(settlements), _c(density)
    return (
        F.when(n == 0, "minimal").when(d > 50, "critical").when((d > 20) | (n > 50), "high").when((d > 5) | (n > 20), "moderate").otherwise("low")
    )


def fire_level(fires, max_frp) -> Column:
    n = _c(fires)
    return F.when(n >= 100, "critical").when(n >= 50, "warning").when(n >= 20, "info").when(_c(max_frp) > 50, "warning").otherwise("info")


def plausible(speed, kind) -> Column:
    """Neither too slow nor too fast for a herd, and no managed burn."""
    return _c(speed).between(0.5, 30) & ~_c(kind).contains("management")


def dry_season_of(lat, month) -> Column:
    """Dry months by hemisphere."""
    return F.when(_c(lat) > 0, _c(month).isin(1, 2, 3, 11, 12)).otherwise(_c(month).between(5, 10))


def transhumance_season(month) -> Column:
    return _c(month).isin(11, 12, 1, 2, 3)


def season(month) -> Column:
    return F.when((_c(month) >= 11) | (_c(month) <= 4), "dry").otherwise("rainy")


def change_direction(now, before, percent: float = 10.0, up: str = "up", down: str = "down") -> Column:
    """The direction of a change of more than some percent; stable if there is nothing to compare with."""
    now, before = _c(now), _c(before)
    change = (now - before) / F.when(before > 0, before) * 100
    return F.when(change > percent, up).when(change < -percent, down).otherwise("stable")
