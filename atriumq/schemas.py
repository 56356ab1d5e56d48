"""Types of the engine's tables, and what a reader puts where a document leaves a field out."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
POLYGON = f"struct<outer:array<{POINT}>,holes:array<array<{POINT}>>>"

TABLES: dict[str, str] = {
    "floorplans": "id string, name string, building_name string, floor_label string, original_filename string, stored_filename string, media_type string, created_at timestamp",
    "spatial_models": f"floorplan_id string, pixels_per_meter double, walls array<struct<id:string,start:{POINT},end:{POINT}>>, nodes array<struct<id:string,position:{POINT},label:string,kind:string>>, pois array<struct<id:string,name:string,category:string,position:{POINT},node_id:string>>, updated_at timestamp",
    "structural_maps": f"floorplan_id string, parser string, parser_version string, image_width int, image_height int, walls array<{POLYGON}>, obstacles array<{POLYGON}>, windows array<{POLYGON}>, openings array<struct<id:string,kind:string,polygon:{POLYGON},confidence:double,width_px:double>>, spaces array<struct<id:string,kind:string,label:string,polygon:{POLYGON},area_px:double,confidence:double>>, walkable array<{POLYGON}>, status string, metrics map<string,double>, estimated_pixels_per_meter double, scale_source string, updated_at timestamp",
    "navigation_configs": "floorplan_id string, edges array<struct<id:string,from_node_id:string,to_node_id:string,kind:string,accessible:boolean>>, vertical_connectors array<struct<id:string,kind:string,label:string,source_node_id:string,target_floorplan_id:string,target_node_id:string,accessible:boolean,bidirectional:boolean>>, updated_at timestamp",
    "positioning_configs": "floorplan_id string, qr_anchors array<struct<id:string,code:string,label:string,node_id:string>>, updated_at timestamp",
}
#: The key that one row of each table is found by.
KEYS = {"floorplans": "id", "spatial_models": "floorplan_id", "structural_maps": "floorplan_id", "navigation_configs": "floorplan_id", "positioning_configs": "floorplan_id"}
#: What missing fields are read as.
READ_DEFAULTS = {"edge_kind": "corridor", "accessible": True, "bidirectional": True, "node_kind": "waypoint", "node_label": "Nodo"}
