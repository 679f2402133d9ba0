"""Word lists of the file score."""

# Words, path parts and file patterns that the score is defined by.
SECURITY_KEYWORDS = (
    "auth", "login", "password", "secret", "key", "token", "credential", "jwt", "oauth", "session", "cookie",
    "encrypt", "decrypt", "hash", "signature", "verify", "role", "permission", "acl", "rbac", "admin", "user",
    "account", "profile", "registration", "signup", "signin", "logout", "database", "db", "sql", "query", "exec",
    "shell", "system", "os", "subprocess", "command", "net", "http", "request", "response", "router", "route",
    "endpoint", "controller", "api", "middleware", "bypass", "guard", "barrier",
)
AUTH_GUARD_KEYWORDS = ("checkpermission", "requireauth", "authguard", "jwt.verify", "validate-request", "notauthorized", "permissionguard")
FRONTEND_PATH_HINTS = ("frontend/", "client/", "ui/", "web/", "public/", "static/", "assets/", "components/", "views/")
BACKEND_PATH_HINTS = ("backend/", "server/", "api/", "routes/", "routers/", "controllers/")
FRONTEND_SUFFIXES = ("tsx", "jsx", "vue", "svelte")
CRITICAL_FILE_PATTERNS = (
    "*auth*", "*security*", "*config*", "*secret*", "*key*", "*token*", "*database*", "*db*", "*model*",
    "*controller*", "*route*", "*api*", "*endpoint*", "*.env*", "dockerfile", "docker-compose.yml",
    "requirements.txt", "pyproject.toml", "go.mod", "cargo.toml", "package.json", "composer.json",
    "appsettings.json",
)
NOISE_PATTERNS = (
    "*.css", "*.svg", "*.lock", "*.min.js", "*.map", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.woff",
    "*.woff2", "*.ttf", "*.eot", "*test*", "*spec*", "*mock*", "node_modules/", "venv/", ".venv/", "dist/",
    "build/", ".git/", "__pycache__/", ".pytest_cache/", ".ruff_cache/", ".mypy_cache/", ".dccache",
    ".scannerwork/", "pnpm-lock.yaml", "package-lock.json", "yarn.lock",
)
