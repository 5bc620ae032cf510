"""Schemas of the stores."""

TM = "entry_id long, source string, target string, origin string, source_lang string, target_lang string"
GLOSSARY = "entry_id long, source_term string, target_term string, source_lang string, target_lang string, note string, origin string"
NODES = (
    "id string, type string, term string, label string, phrase string, lang string, domain string, definition string, is_phrase boolean, frequency long, display_form string, "
    "variants array<string>, source_text string, target_text string, source_lang string, target_lang string, origin string, quality_score double, parent string, created_at string, props map<string,string>"
)
EDGES = "src string, dst string, relation string, confidence double, verified boolean, provenance string, context string, validated_by string, last_updated string, pos long"
SEGMENT = "struct<id:int,source:string,target:string,status:string>"
PROJECT = f"id string, filename string, lang_pair string, active_index int, saved_at string, total int, done int, segments array<{SEGMENT}>"
#: The parts of an interchange document; attributes of its own names only, so no edge attribute can replace an endpoint.
NODE_JSON = NODES.replace("props map<string,string>", "props map<string,string>")
EDGE_JSON = "source string, target string, relation string, confidence double, verified boolean, provenance string, context string, validated_by string, last_updated string"
