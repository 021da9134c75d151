"""File names, extensions, exclusion rules and colours that results depend on."""

# Fixed values.
LANGUAGE_BY_NAME = {
    "BUILD": "Starlark",
    "BUILD.bazel": "Starlark",
    "BUILD.gn": "GN",
    "CMakeLists.txt": "CMake",
    "Dockerfile": "Dockerfile",
    "Makefile": "Makefile",
    "WORKSPACE": "Starlark",
}

# Fixed values.
LANGUAGE_BY_EXTENSION = {
    "c": "C", "cc": "C++", "cjs": "JavaScript", "cpp": "C++", "cs": "C#", "css": "CSS", "cxx": "C++", "dart": "Dart",
    "ex": "Elixir", "exs": "Elixir", "gn": "GN", "gni": "GN", "go": "Go", "h": "C", "hh": "C++", "hpp": "C++",
    "hs": "Haskell", "html": "HTML", "java": "Java", "js": "JavaScript", "json": "JSON", "jsx": "JavaScript",
    "kt": "Kotlin", "lua": "Lua", "m": "Objective-C", "md": "Markdown", "mjs": "JavaScript", "mm": "Objective-C++",
    "mts": "TypeScript", "php": "PHP", "prisma": "Prisma", "proto": "Protocol Buffer", "py": "Python", "rb": "Ruby",
    "rs": "Rust", "scala": "Scala", "scss": "SCSS", "sh": "Shell", "sql": "SQL", "swift": "Swift", "toml": "TOML",
    "ts": "TypeScript", "tsx": "TypeScript", "vue": "Vue", "wgsl": "WGSL", "xml": "XML", "yaml": "YAML", "yml": "YAML",
    "zig": "Zig",
}

OTHER = "Other"

# Fixed values.
EXCLUDED_DIRS = ["node_modules", "third_party", "vendor", "dist"]
LOCKFILES = ["Cargo.lock", "Gemfile.lock", "Pipfile.lock", "composer.lock", "go.sum", "npm-shrinkwrap.json", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock"]
MINIFIED_SUFFIXES = [".min.js", ".min.css"]
GENERATED_MARKERS = ["@generated", "@auto-generated", "DO NOT EDIT", "Code generated by", "Generated by the protocol buffer compiler"]
HEADER_LINES, HEADER_BYTES = 5, 2048
SNIFF_BYTES = 8192
MAX_FILE_BYTES = 2 * 1024 * 1024

# Fixed values.
COLORS = {
    "C": "#555555", "C++": "#f34b7d", "C#": "#178600", "CSS": "#563d7c", "Go": "#00add8", "HTML": "#e34c26", "Java": "#b07219",
    "JavaScript": "#f1e05a", "JSON": "#969696", "Kotlin": "#a97bff", "Markdown": "#083fa1", "Objective-C": "#438eff",
    "PHP": "#4f5d95", "Python": "#3572a5", "Ruby": "#701516", "Rust": "#dea584", "Shell": "#89e051", "SQL": "#e38c00",
    "Swift": "#f05138", "TOML": "#9c4221", "TypeScript": "#3178c6", "YAML": "#cb171e", "Other": "#8a929c",
}

#: Grammars whose files are parsed.
GRAMMARS = ["Rust", "Go", "Python", "JavaScript", "TypeScript", "TSX", "C", "C++", "Java", "C#", "Ruby", "PHP"]

# Why a source isn't allowed, in the order of the rules.
NOT_A_URL = "not a valid URL"
NOT_HTTPS = "only https:// sources are allowed"
HAS_CREDENTIALS = "credentials in the URL are not allowed"
OTHER_PORT = "only the default https port is allowed"
HAS_QUERY = "query strings and fragments are not allowed"
IS_ADDRESS = "IP-literal hosts are not allowed"
OTHER_HOST = ("host ", " is not in the allowlist")
