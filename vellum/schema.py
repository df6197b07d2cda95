"""Schemas of the engine's tables."""

DOC_SCHEMA = "doc_index long, set_id string, source_id long, chunk_no int, format string, path string, name string, ext string, size long, mtime timestamp, tags array<string>, data_json string, content string, message_name string"
NODE_SCHEMA = "node_id int, parent_id int, depth int, ord int, type string, tag string, props map<string,string>, value string, line int"
MESSAGE_SCHEMA = "seq long, name string, data_json string, from_index long, from_name string"
OUTPUT_SCHEMA = "path string, content string"
