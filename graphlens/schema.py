"""Kinds, flags, fixed word lists and table layouts of the code graph."""

from __future__ import annotations

ATOMS = "id string, kind string, name string, file_path string, line_start int, line_end int, doc string, signature string, content_hash string, parent string, scope string, seq bigint"
CALL_SITES = "caller_id string, name string, rank int, flags int, is_method boolean"
EDGES = "src string, dst string, kind string, role string, sites array<int>, seq bigint"
IMPORTS = "module_id string, local string, target string, is_glob boolean, is_public boolean, pos int"
TYPE_REFS = "atom_id string, written string, pos int"

AWAIT, CONDITIONAL, REPEATED, TYPED_RECEIVER = 1, 2, 4, 8
#: Kinds that a project roll-up counts as structures, and edges may lead to.
STRUCT_KINDS = ("struct", "enum", "trait", "type_alias", "union", "impl")
EXTERN = "extern"

# Names too common to link.
SKIP_CALLS = tuple(
    "unwrap expect ok err is_some is_none is_ok is_err unwrap_or unwrap_or_default unwrap_or_else "
    "map and_then or_else filter fold collect iter iter_mut into_iter next count sum any all find position "
    "to_string to_owned to_vec clone as_ref as_mut as_str as_bytes as_slice from into try_into try_from "
    "len is_empty push pop insert remove get contains new default with_capacity drain extend "
    "println print eprintln eprint format write writeln str int list dict tuple set type range enumerate zip sorted reversed isinstance".split()
)
# Words that a flowchart reserves.
RESERVED = ("graph", "subgraph", "end", "flowchart", "direction", "click", "class", "classDef", "linkStyle", "style", "default", "interpolate", "accTitle", "accDescr")
# Heads of paths that name no dependency.
NO_DEPENDENCY = tuple("std core alloc self super crate u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str".split())
# Directories that a scan leaves out.
EXCLUDED_DIRS = ("target", "node_modules", ".git", "__pycache__", "venv", "dist", "build", "vendor")
# Suffixes of generated Dart files.
GENERATED_DART = (".g.dart", ".freezed.dart", ".mocks.dart", ".gr.dart")
# Short words for kinds in labels.
SHORT_KINDS = {"function": "fn", "struct": "struct", "trait": "trait", "impl": "impl", "enum": "enum", "type_alias": "type", "const": "const", "static": "static", "macro": "macro"}
