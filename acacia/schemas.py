"""Canonical schemas of the tables, as DDL strings."""

from __future__ import annotations

#: Raw satellite detections; older products name the two brightness columns differently.
DETECTION_CSV = (
    "latitude string, longitude string, bright_ti4 string, scan string, track string, acq_date string, acq_time string, satellite string, "
    "instrument string, confidence string, version string, bright_ti5 string, frp string, daynight string"
)
DETECTION_KEY = ["latitude", "longitude", "acq_date", "acq_time", "satellite"]
DETECTION = (
    "latitude double, longitude double, brightness double, scan double, track double, acq_date date, acq_time string, satellite string, "
    "instrument string, confidence string, version string, bright_t31 double, frp double, daynight string"
)
TRACK_POINT = "file string, track_no int, seg_no int, pt_no int, lat double, lon double, ele double, ts timestamp, description string"
GEOMETRY = "struct<type:string,coordinates:string>"
AREA = "ord int, id string, name string, country string, country_code string, wdpa_id string, area_km2 double, partner string, rings array<array<array<double>>>, buffer_km double"
CLUSTER_DAY = "park_id string, acq_date date, cid int, lat double, lon double, lat_min double, lat_max double, fires int, frp double, spread_km double"
TRAJECTORY_NODE = "traj_id int, seq int, park_id string, acq_date date, cid int, lat double, lon double, fires int, spread_km double"
#: The one document shape of a trajectory; readers accept no other.
TRAJECTORY_DOCUMENT = (
    "struct<origin:struct<lat:double,lon:double,date:string>,dest:struct<lat:double,lon:double,date:string>,entry_date:string,last_inside:string,"
    "days_inside:int,fires_inside:int,outcome:string,path:array<struct<date:string,lat:double,lon:double,fires:int>>>"
)
INFRACTIONS = (
    "park_id string, year int, total_groups int, groups_stopped_inside int, groups_transited int, groups_stopped_after int, transhumance_groups int, "
    f"herder_groups int, avg_days_burning double, median_days_burning double, max_days_burning int, total_fires_inside int, trajectories array<{TRAJECTORY_DOCUMENT}>, analyzed_at timestamp"
)
EFFORT = "grid_cell_id string, year int, month int, day int, movement_type string, total_distance_km double, total_points bigint, unique_uploads bigint, coverage_percent double"
PLACE = "id bigint, park_id string, place_type string, name string, lat double, lon double, osm_id bigint, osm_tags string"
PIXEL = "park_id string, tile string, r int, c int, value int"
SETTLEMENT = "park_id string, lat double, lon double, area_m2 double, population_est bigint, households_est bigint, nearest_place string, distance_km double, direction string, settlement_type string"
WORK = "id string, title string, publication_year int, doi string, cited_by_count int, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>"
