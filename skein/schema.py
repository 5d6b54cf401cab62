"""Schemas of persisted tables."""

NODES = (
    "node_id string, url string, depth int, scanned boolean, should_scan boolean, can_create_edges boolean, metadata map<string,string>, "
    "user_data map<string,string>, response_status int, content_hash string, priority int, created_at timestamp_ntz, lifecycle_stage string"
)
EDGES = "edge_id string, source_node_id string, target_node_id string, metadata map<string,string>, created_at timestamp_ntz"
