"""Names of APIs that sources, sinks, sanitizers, controllers and barriers are known by.

Fixed values throughout: regular expressions over full names (Java syntax, whole match),
by language and family.  A sink given as (pattern, n) takes a non-literal n-th argument;
one given as a pattern alone takes anything.  ``name:`` looks at the simple name.
"""

LANGUAGES = ("java", "csharp", "python", "javascript")

WEB_ANNOTATIONS = {
    "java": ("RequestParam", "RequestBody", "PathVariable", "RequestHeader", "QueryParam", "PathParam", "HeaderParam", "CookieParam", "FormParam", "MatrixParam"),
    "csharp": ("FromQuery", "FromBody", "FromRoute", "FromForm", "FromHeader", "FromServices"),
}
REQUEST_FIELDS = {
    "python": "(GET|POST|FILES|COOKIES|META|headers|args|form|values|json|data|query_params)",
    "csharp": "(Query|Body|Cookies|Headers|Form)",
    "javascript": "body|query|params|headers|cookies|files",
    "javascript-ctx": "request|query|params|headers|state|body",
}
URL_FIELDS = ".*(url|uri|host|target|dest|destination|redirect|next).*"
DESTRUCTURED = r"param\d+_\d+"

CONTROLLER_ANNOTATIONS = {
    "java": "RequestMapping|GetMapping|PostMapping|PatchMapping|DeleteMapping|PutMapping|RestController|Controller|MessageMapping|Path|GET|POST|PUT|DELETE|PATCH|Produces|Consumes",
    "csharp": "Route|HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|HttpHead|HttpOptions|ApiController",
    "python": "(get|post|put|delete|patch|route|login_required)",
    "javascript": "(?i)(get|post|put|delete|patch|options|head|all)",
}
BARRIER_CALLS = {
    "java": ".*(assertAuth|checkAuth|isAuthorized|isAuthenticated|hasPermission|verifyToken|validateUser).*",
    "csharp": ".*(IsAuthenticated|HasPermission|checkAuth|VerifyToken|ValidateUser).*",
    "python": ".*(auth|login|verify_token|check_perm|authenticate).*",
    "javascript": r".*(auth|authenticate|authorize|verifyToken|verify|isAuthenticated|requireAuth|security\.).*",
}
BARRIER_ANNOTATIONS = {
    "java": "PreAuthorize|Secured|RolesAllowed|RequiresAuthentication|RequiresPermissions|Authorize|Authenticated",
    "csharp": "Authorize|AuthorizeJwtBearer",
    "python": ".*(auth|login|permission|requires_auth|restricted).*",
    "javascript": "(?i)(UseGuards|AuthGuard|JwtAuthGuard|Roles|RoleGuard|PermissionGuard)",
}
BYPASS_ANNOTATIONS = {
    "java": "PermitAll|AnonymousAllowed|Unauthenticated",
    "csharp": "AllowAnonymous|AllowUnauthenticated",
    "python": "(public|allow_anonymous|csrf_exempt)",
    "javascript": "(?i)(Public|AllowAnonymous|PermitAll|SkipAuth)",
}
BARRIER_HEURISTICS = {
    "java": ("(?i).*(PreAuthorize|Secured|RolesAllowed|RequiresAuthentication|RequiresPermissions|Authorize|Authenticated).*", "(?i).*(assertAuth|checkAuth|isAuthorized|isAuthenticated|hasPermission|verifyToken|validateUser).*"),
    "csharp": ("(?i).*(Authorize|AuthorizeJwtBearer).*", "(?i).*(IsAuthenticated|HasPermission|checkAuth|VerifyToken|ValidateUser).*"),
    "python": ("(?i).*(auth|login|verify_token|check_perm|authenticate).*", "(?i).*(requires_auth|restricted|login_required).*", r".*\.is_authenticated"),
    "javascript": ("(?i).*(UseGuards|AuthGuard|JwtAuthGuard|Roles|RoleGuard|PermissionGuard).*", r"(?i).*(auth|authenticate|authorize|verifyToken|verify|isAuthenticated|requireAuth|security\.).*"),
}

SANITIZER = ".*(escape|sanitize|encode|quote|validate|check|basename|abspath|realpath).*"

#: (language, family): alternatives for precision and, where it differs, for broad coverage.
SINKS = {
    ("java", "sql"): (
        [(r".*(Statement\.execute(Query|Update)?|JdbcTemplate\.query|JdbcTemplate\.update|EntityManager\.createNativeQuery|Session\.createSQLQuery).*", 1)],
        [(r".*(Statement\.execute(Query|Update)?|JdbcTemplate\.query|JdbcTemplate\.update|EntityManager\.(createNativeQuery|createQuery|createNamedQuery|createStoredProcedureQuery)|Session\.(createSQLQuery|createQuery|createNativeQuery)).*", 1)],
    ),
    ("java", "command"): ([(r".*(ProcessBuilder\.command|Runtime\.exec).*", 1)],),
    ("java", "ssrf"): (
        [(r".*(Jsoup\.connect|HttpClient\..*|RestTemplate\..*|OkHttpClient\..*|URLConnection\.connect|HttpURLConnection\.connect|URL\.openStream|URL\.openConnection).*", 1)],
        [(r".*((HttpClient|RestTemplate|OkHttpClient|WebClient|URLConnection|HttpURLConnection)\..*|.*\.connect|URL\.openStream|URL\.openConnection).*", 1)],
    ),
    ("java", "xxe"): (
        [r".*(DocumentBuilderFactory\.newDocumentBuilder|SAXParserFactory\.newSAXParser|XMLInputFactory\.newXMLStreamReader).*"],
        [r".*(DocumentBuilderFactory\.newDocumentBuilder|SAXParserFactory\.newSAXParser|XMLInputFactory\.newXMLStreamReader|DocumentBuilder\.parse|SAXParser\.parse|XMLReader\.parse).*"],
    ),
    ("java", "deserialization"): ([r".*(ObjectInputStream\.readObject|XMLDecoder\.readObject).*"], [r".*(ObjectInputStream\.(readObject|readUnshared)|ObjectInput\.(readObject|readUnshared)|XMLDecoder\.readObject).*"]),
    ("java", "template"): ([r".*(Template\.process|SpringTemplateEngine\.process).*"], [r".*(Template\.process|VelocityEngine\.evaluate|Velocity\.evaluate|StringTemplate\.render|SpringTemplateEngine\.process).*"]),
    ("java", "redirect"): ([".*sendRedirect.*"], [".*(sendRedirect|RedirectView).*"]),
    ("java", "archive"): ([r".*(ZipInputStream\.getNextEntry|ZipFile\.getEntry).*"], [r".*(ZipInputStream\.getNextEntry|ZipFile\.getEntry|TarArchiveInputStream\.getNextTarEntry|ArchiveStreamFactory\.createArchiveInputStream).*"]),
    ("java", "population"): ([r".*BeanUtils\.copyProperties.*", r".*ModelMapper\.map.*", r".*PropertyUtils\.copyProperties.*"],),
    ("csharp", "sql"): ([(r".*(FromSql.*|ExecuteSql(Command|Raw|Interpolated).*|(SqlMapper|IDbConnection|DbConnection)\.(Query|Execute|QueryAsync|ExecuteAsync|ExecuteScalar).*|Execute(Reader|Scalar|NonQuery).*|(SqlCommand|SqliteCommand).*(<init>|CommandText).*)", 1), r".*SqlCommand\.Execute(Reader|Scalar|NonQuery|XmlReader).*"],),
    ("csharp", "ssrf"): ([(r".*(HttpClient|WebClient)\..*(Get|Post|Send|Download|Create).*", 1)], [(r".*(HttpClient\..*|WebClient\..*|WebRequest\.Create|.*\.GetStringAsync).*", 1)]),
    ("csharp", "command"): ([(r".*(Process\.Start|PowerShell\.AddScript|ProcessStartInfo).*", 1)], [(r".*(Process\.Start|ProcessStartInfo\..*|PowerShell\.AddScript).*", 1), r".*PowerShell\.Invoke.*"]),
    ("csharp", "path"): (
        [(r".*(File\.(ReadAllText|ReadAllBytes|WriteAllText|WriteAllBytes|Open|OpenRead|OpenWrite|Create)|Directory\.(GetFiles|EnumerateFiles|CreateDirectory|Delete)).*", 1)],
        [(r".*(File\.(ReadAllText|ReadAllBytes|WriteAllText|WriteAllBytes|Open|OpenRead|OpenWrite|Create)|Directory\.(GetFiles|EnumerateFiles|CreateDirectory|Delete)|FileInfo|DirectoryInfo).*", 1)],
    ),
    ("csharp", "xml"): ([r".*(XmlSerializer\.Deserialize|XmlDocument\.Load|XmlReader\.Create|.*\.LoadXml).*"],),
    ("csharp", "template"): ([r".*(RazorEngine\.Run|RazorLightEngine\.CompileRender).*"], [r".*(RazorEngine\.Run|RazorLightEngine\.CompileRender|Scriban\.Template\.Parse|DotLiquid\.Template\.Parse).*"]),
    ("csharp", "redirect"): ([".*(Redirect|RedirectToAction).*"], [".*(Redirect|RedirectPermanent|RedirectToAction|RedirectToRoute).*"]),
    ("csharp", "crypto"): ([r".*(MD5\.Create|SHA1\.Create).*"], [r".*(MD5\.Create|SHA1\.Create|HMACMD5\.Create|SHA1Managed).*"]),
    ("csharp", "archive"): ([(r".*ZipFile\.ExtractToDirectory.*", 1)], [(r".*(ZipFile\.ExtractToDirectory|ZipArchive\.ExtractToDirectory).*", 1)]),
    ("csharp", "population"): ([r".*ControllerBase\.(Try)?UpdateModelAsync.*", r".*Mapper\.Map.*", r".*IMapper\.Map.*"],),
    ("python", "code"): ([("name:(exec|eval)", 1), (r".*ImageMath\.eval.*", 1), r".*code\.Interactive.*"],),
    ("python", "command"): ([(r".*subprocess.*\.(run|call|check_call|check_output|Popen).*", 1), (r".*os.*\.(system|popen|spawn.*|exec.*).*", 1)],),
    ("python", "sql"): ([("name:(execute|raw)", 1), r".*(django\.db\.models\.query\.QuerySet\.raw|django\.db\.connection\.cursor).*"],),
    ("python", "stacked"): ([("name:executescript", 1), (".*executescript.*", 1)],),
    ("python", "path"): ([("name:open", 1), (r".*(os.*\.(open|listdir|remove|rmdir|mkdir|makedirs)|shutil.*\.(copy|move)).*", 1), (r".*django\.core\.files\.storage\.Storage\.(save|open).*", 2)],),
    ("python", "deserialization"): ([(r".*((pickle|_pickle|marshal).*\.(loads|load)|yaml.*\.(load|load_all|unsafe_load)).*", 1)],),
    ("python", "ssrf"): ([(r".*(requests.*\.(get|post|put|delete|patch|head|options|request)|urllib\.request.*\.urlopen|aiohttp\.ClientSession.*).*", 1)],),
    ("python", "template"): (
        [r".*(jinja2\.Environment.*\.from_string|flask.*\.render_template_string|django\.template\.Template).*"],
        [r".*(jinja2\.Template.*\.render|jinja2\.Environment.*\.from_string|flask.*\.render_template_string|django\.template\.Template|django\.template\.loader\.render_to_string|django\.shortcuts\.render).*"],
    ),
    ("python", "redirect"): (
        [r".*(flask.*\.redirect|django\.shortcuts\.redirect|django\.http\.HttpResponseRedirect|fastapi\.responses\.RedirectResponse).*"],
        [r".*(flask.*\.redirect|django\.shortcuts\.redirect|django\.http\.HttpResponseRedirect|starlette\.responses\.RedirectResponse|fastapi\.responses\.RedirectResponse).*"],
    ),
    ("python", "crypto"): ([r".*hashlib\.(md5|sha1).*"], [r".*hashlib\.(md5|sha1).*", r".*Crypto\.Cipher\.(AES|DES|ARC4).*"]),
    ("python", "archive"): ([(r".*zipfile\.ZipFile\.extractall.*", 1)], [(r".*(zipfile\.ZipFile\.extractall|tarfile\.TarFile\.extractall|shutil\.unpack_archive).*", 1)]),
    ("javascript", "code"): ([(r".*(eval|Function|vm.*[:\.]run(InNewContext|InContext|Script)).*", 1)],),
    ("javascript", "command"): ([(r".*child_process.*[:\.](exec|execSync|spawn|spawnSync|execFile|execFileSync).*", 1)],),
    ("javascript", "sql"): (
        [(r".*(sequelize.*[:\.]query|knex.*[:\.]raw|pg.*[:\.]query|mysql.*[:\.]query|mariadb.*[:\.]query|sqlite3.*[:\.](all|get|run)|typeorm.*[:\.]query|prisma.*[:\.]\$queryRaw|prisma.*[:\.]\$executeRaw).*", 1)],
        [(r".*(sequelize.*[:\.]query|knex.*[:\.](raw|whereRaw)|pg.*[:\.]query|mysql.*[:\.]query|mariadb.*[:\.]query|sqlite3.*[:\.](all|get|run)|typeorm.*[:\.]query|prisma.*[:\.]\$queryRaw|prisma.*[:\.]\$executeRaw).*", 1)],
    ),
    ("javascript", "stacked"): ([(r".*(sqlite3.*[:\.]exec|better-sqlite3.*[:\.]exec|mssql.*[:\.]batch|tedious.*[:\.]execSqlBatch).*", 1)],),
    ("javascript", "ssrf"): (
        [(r".*(axios($|[:\.](get|post|put|delete|head|options|request))|fetch|node-fetch|http.*[:\.](get|request)|https.*[:\.](get|request)).*", 1)],
        [(r".*(axios($|[:\.](get|post|put|delete|head|options|request))|fetch|node-fetch|http.*[:\.](get|request)|https.*[:\.](get|request)|request[:\.].*|superagent[:\.].*|got[:\.].*).*", 1)],
    ),
    ("javascript", "path"): ([(r".*fs.*[:\.](readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|unlink|readdir|readdirSync|mkdir|mkdirSync|rmdir|rmdirSync|open|openSync).*", 1)],),
    ("javascript", "deserialization"): ([(r".*((node-serialize|serialize).*[:\.]unserialize|yaml.*[:\.]load).*", 1)],),
    ("javascript", "template"): ([(r".*(ejs.*[:\.]render|handlebars.*[:\.]compile|nunjucks.*[:\.]renderString).*", 1)], [(r".*(ejs.*[:\.]render|pug.*[:\.]render|handlebars.*[:\.]compile|mustache.*[:\.]render|nunjucks.*[:\.]renderString).*", 1)]),
    ("javascript", "redirect"): ([(r".*[:\.]redirect.*", 1)],),
    ("javascript", "archive"): ([(r".*adm-zip.*[:\.]extractAllTo.*", 1)], [(r".*(adm-zip.*[:\.]extractAllTo|unzipper.*[:\.]Extract|tar.*[:\.]extract|tar-fs.*[:\.]extract).*", 1)]),
    ("javascript", "population"): ([r".*Object.*[:\.]assign.*", r".*lodash.*[:\.]merge.*", r".*_\.merge.*"],),
    ("javascript", "prototype"): (
        [(r".*(Object.*[:\.]assign|Object.*[:\.]defineProperty|Object.*[:\.]defineProperties|lodash.*[:\.]merge|_\.merge|_\.defaultsDeep).*", 1)],
        [(r".*(Object.*[:\.]assign|Object.*[:\.]defineProperty|Object.*[:\.]defineProperties|lodash.*[:\.]merge|_\.merge|_\.defaultsDeep|defaultsDeep|merge|extend|setWith|set|zipObjectDeep).*", 1)],
    ),
}
#: Hash algorithms by name: the call that takes it, and names for precision and for broad coverage.
NAMED_HASHES = {
    "java": (r".*MessageDigest\.getInstance.*", ("MD5", "SHA1"), ("MD5", "SHA1", "MD2")),
    "javascript": (r".*crypto.*[:\.]createHash.*", ("md5", "sha1"), ("md5", "sha1", "md4")),
    "python": (r".*hashlib\.new.*", (), ("md5", "sha1")),
}
GUARDS = {
    ("python", "path"): [r".*(os\.path.*\.(abspath|realpath|normpath|basename)|pathlib\.Path.*\.(resolve|absolute)).*", "name:basename"],
    ("python", "redirect"): [".*(is_safe_url|url_has_allowed_host_and_scheme).*"],
    ("java", "xxe"): [".*(setFeature|setProperty|setXIncludeAware|setExpandEntityReferences).*"],
    ("java", "deserialization"): [".*(ObjectInputFilter|ValidatingObjectInputStream|SafeObjectInputStream).*"],
    ("java", "archive"): [".*(getCanonicalPath|normalize|toRealPath).*"],
    ("csharp", "path"): [r".*Path\.(GetFullPath|GetFileName|GetFileNameWithoutExtension|GetDirectoryName|Combine|Join).*"],
    ("csharp", "redirect"): [r".*(Url\.IsLocalUrl|LocalRedirect).*"],
    ("javascript", "path"): [r".*path.*[:\.]basename.*", ".*(sanitize.*(path|filename)|safeJoin|pathIsInside|isPathInside|is-path-inside|path-is-inside).*"],
    ("javascript", "template"): [r".*fs.*[:\.]readFile(Sync)?.*"],
    ("javascript", "prototype"): [r".*(hasOwnProperty|Object[:\.]hasOwn).*"],
}
BASE_DIRECTORIES = ".*(base|root|dir|path|allowed|public|static|uploads).*"

_SUSPICIOUS = {
    "Command Execution": ("cmd", "command", "args", "shell", "script"),
    "Database": ("sql", "query", "table", "where"),
    "File System": ("path", "filename", "filepath", "dest", "src"),
    "Network": ("url", "host", "uri", "endpoint"),
    "Code Injection": ("code", "data", "expr", "payload"),
    "Cryptography": ("password", "secret", "key", "token", "hash", "salt"),
}
SUSPICIOUS = _SUSPICIOUS
WEIGHTS = {"Command Execution": 10, "Database": 9, "File System": 7, "Network": 8, "Code Injection": 10, "Cryptography": 6}
DISCOVERY = {
    "python": {
        "Command Execution": (".*subprocess.*(run|call|check_call|check_output|Popen).*", ".*os.*(system|popen|spawn|exec).*"),
        "Database": (".*(execute|raw|executescript).*", r".*django\.db\.(models\.query\.QuerySet\.raw|connection\.cursor).*"),
        "File System": (".*(open).*", ".*os.*(open|listdir|remove|rmdir|mkdir|makedirs).*", r".*shutil\.(copy|move).*"),
        "Network": (r".*requests\.(get|post|put|delete|patch|head|options|request).*", r".*urllib\.request\.urlopen.*", r".*aiohttp\.ClientSession.*"),
        "Code Injection": (".*(exec|eval).*", r".*ImageMath\.eval.*", r".*code\.Interactive.*"),
        "Cryptography": (r".*(hashlib\.(md5|sha|new)|hmac\.new|secrets\..*|cryptography\..*|jwt\.(encode|decode)|passlib\..*|bcrypt\..*).*",),
    },
    "java": {
        "Command Execution": (r".*java\.lang\.Runtime\.exec.*", r".*java\.lang\.ProcessBuilder\.(start|<init>).*"),
        "Database": (r".*java\.sql\.Statement\.execute.*", r".*java\.sql\.Connection\.prepare(Statement|Call).*", r".*org\.hibernate\.Session\.create(Query|SQLQuery|NativeQuery).*", r".*javax\.persistence\.EntityManager\.create(Query|NativeQuery).*", r".*org\.springframework\.jdbc\.core\.JdbcTemplate.*"),
        "File System": (r".*java\.io\.File\.(<init>).*", r".*java\.io\.FileInputStream\.(<init>).*", r".*java\.io\.FileOutputStream\.(<init>).*", r".*java\.nio\.file\.Files\.(read|write|new|copy|move|delete|create).*"),
        "Network": (r".*java\.net\.URL\.open(Stream|Connection).*", r".*org\.apache\.http\.client\.HttpClient\.execute.*", r".*okhttp3\.OkHttpClient\.newCall.*", r".*org\.springframework\.web\.client\.RestTemplate.*"),
        "Code Injection": (r".*javax\.script\.ScriptEngine\.eval.*", r".*org\.mvel2\.MVEL\.eval.*", r".*org\.springframework\.expression\.ExpressionParser\.parseExpression.*"),
        "Cryptography": (r".*(java\.security\.MessageDigest\.getInstance|javax\.crypto\.Cipher\.getInstance|java\.security\.Signature\.getInstance|javax\.crypto\.KeyGenerator\.getInstance|javax\.crypto\.SecretKeyFactory\.getInstance|.*\.JWT\.create|.*\.Jwts\.builder).*",),
    },
    "csharp": {
        "Command Execution": (r".*System\.Diagnostics\.Process\.Start.*", r".*System\.Management\.Automation\.PowerShell\.Invoke.*"),
        "Database": (r".*Microsoft\.EntityFrameworkCore.*ExecuteSql.*", r".*Microsoft\.EntityFrameworkCore.*FromSql.*", r".*System\.Data\.SqlClient\.SqlCommand\.Execute.*", r".*Dapper\.SqlMapper\.Query.*"),
        "File System": (r".*System\.IO\.File\.(Open|Read|Write|Delete|Copy|Move).*", r".*System\.IO\.Directory\.(CreateDirectory|Delete|GetFiles|GetDirectories).*", r".*System\.IO\.FileInfo\.(<init>).*", r".*System\.IO\.DirectoryInfo\.(<init>).*"),
        "Network": (r".*System\.Net\.Http\.HttpClient\.(Get|Post|Put|Delete|Send|Request).*Async.*", r".*System\.Net\.WebRequest\.Create.*", r".*System\.Net\.WebClient\.(Download|Upload).*Async.*"),
        "Code Injection": (r".*Microsoft\.CodeAnalysis\.CSharp\.Scripting\.CSharpScript\.Evaluate.*", r".*System\.Reflection\.MethodInfo\.Invoke.*"),
        "Cryptography": (r".*(System\.Security\.Cryptography\.(HashAlgorithm|SymmetricAlgorithm|AsymmetricAlgorithm|KeyDerivation|PBKDF2)|Microsoft\.IdentityModel\.Tokens\.JsonWebTokenHandler|System\.IdentityModel\.Tokens\.Jwt\.JwtSecurityTokenHandler).*",),
    },
    "javascript": {
        "Command Execution": (r".*child_process.*[:\.](exec|execSync|spawn|spawnSync|execFile|execFileSync).*",),
        "Database": (
            r".*(sequelize.*[:\.]query|knex.*[:\.](raw|whereRaw)|pg.*[:\.]query|mysql.*[:\.]query|mariadb.*[:\.]query|sqlite3.*[:\.](all|get|run)|typeorm.*[:\.]query|prisma.*[:\.]\$(queryRaw|executeRaw)).*",
            r".*(Cache|Redis|Memcached|Store).*[:\.](set|put|add|save|get|fetch|retrieve|del|delete|has).*",
            r".*(DataSource|TransactionManager|QueryRunner|UnitOfWork|EntityManager|Connection).*[:\.](commit|rollback|start|begin|connect|open|release|initialize|close|destroy|createQueryRunner|getRepository|createQueryBuilder|manager).*",
            r".*[:\.](startTransaction|beginTransaction|commitTransaction|rollbackTransaction|initialize|connect|release)",
            r".*(QueryBuilder|Criteria|Repository).*[:\.](getMany|getManyAndCount|findAndCount|paginate|toList|fetchAll|execute|save|remove|delete|insert|update|count|findOne|find).*",
            r".*[:\.](getMany|getManyAndCount|findAndCount|createQueryBuilder)",
        ),
        "File System": (
            r".*fs.*[:\.](readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|unlink|readdir|readdirSync|mkdir|mkdirSync|rmdir|rmdirSync|open|openSync).*",
            r"(|.*[:\.])(readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|unlink|readdir|readdirSync|mkdir|mkdirSync|rmdir|rmdirSync|open|openSync|pdfParse)",
        ),
        "Network": (
            r".*(axios($|[:\.](get|post|put|delete|head|options|request))|fetch|node-fetch|http.*[:\.](get|request)|https.*[:\.](get|request)|(^|[:\.])request($|[:\.].*)|superagent[:\.].*|got[:\.].*).*",
            r"(|.*[:\.])(AxiosInstance|Request|Response|Client|req|res|ctx)[:\.](get|post|put|delete|patch|request|send)",
            r".*(Gateway|Connector|Adapter|Client|Consumer|Fetcher|Proxy|GatewayService|ClientService).*[:\.](upload|send|push|sign|process|verify|cancel|revoke|delete|get|fetch|find|request|call).*",
            r".*DigitalSign.*[:\.](sign|verify|process).*",
        ),
        "Code Injection": (r".*(eval|Function|vm.*[:\.]run(InNewContext|InContext|Script)).*",),
        "Cryptography": (r".*(crypto.*[:\.](createHash|createHmac|createCipheriv|createDecipheriv|pbkdf2|scrypt|randomBytes)|bcrypt.*[:\.](hash|compare)|argon2.*[:\.](hash|verify)|jsonwebtoken.*[:\.](sign|verify)).*",),
    },
}

_ALL = ("java", "csharp", "python", "javascript")
#: name, what it finds, sink pattern, languages, coverage.
SLICE_RULES = (
    ("sql-exec", "Calls that execute SQL.", ".*(executeQuery|executeUpdate|execute)", _ALL, "precision"),
    ("orm-raw-sql", "Raw SQL through object mappers.", ".*(FromSql|fromSql|FromSqlRaw|fromSqlRaw|createNativeQuery).*", ("java", "csharp", "javascript"), "precision"),
    ("command-exec", "Calls that start commands.", ".*(exec|system|spawn|popen).*", _ALL, "precision"),
    ("ssrf-http", "Requests to other hosts.", ".*(http|get|post|put|delete|head|request|requests|urlopen|openConnection|HttpClient|WebClient|RestTemplate|OkHttpClient|HttpRequest|fetch|axios).*", _ALL, "broad"),
    ("ssrf-http-precision", "Requests by well-known clients.", ".*(urlopen|openConnection|HttpClient|WebClient|RestTemplate|OkHttpClient|HttpRequest|fetch|axios).*", _ALL, "precision"),
    ("path-traversal", "Reads and writes of files.", r".*(open|read|write|FileInputStream|FileOutputStream|FileReader|FileWriter|Files\.|Path\.|StreamReader|StreamWriter).*", _ALL, "broad"),
    ("path-traversal-precision", "Calls that open files.", r".*(FileInputStream|FileOutputStream|Files\.|Path\.|FileReader|FileWriter|open|read|write).*", _ALL, "precision"),
    ("deserialization", "Unsafe deserialization.", r".*(deserialize|readObject|ObjectInputStream|BinaryFormatter|pickle|yaml\.load|marshal\.loads|XmlSerializer|DataContractSerializer).*", _ALL, "precision"),
    ("xxe", "Parsers that may resolve external entities.", r".*(DocumentBuilder|SAXParser|XMLReader|XmlDocument|XmlReader|XDocument|lxml\.etree|ElementTree\.parse).*", _ALL, "precision"),
    ("template-injection", "Template rendering.", ".*(render|render_template|Template|jinja2|Freemarker|Velocity|Thymeleaf|Razor|Liquid).*", _ALL, "precision"),
    ("code-injection", "Dynamic code.", ".*(eval|exec|compile|CodeDom|Reflection|invoke).*", _ALL, "precision"),
    ("open-redirect", "Redirects.", ".*(redirect|sendRedirect|Location).*", _ALL, "broad"),
    ("file-upload", "Uploads and saved files.", ".*(save|upload|transferTo|WriteAllBytes|WriteAllText).*", _ALL, "precision"),
)

CAPABILITIES = {
    "python": {
        "File System": r"(?i).*(\bopen\b|\bread\b|\bwrite\b|pathlib\.|os\.path|tempfile\.|shutil\.).*",
        "Database": r"(?i).*(execute|query|sql|mongo|redis|sqlalchemy|django\.db|psycopg2|sqlite3|pymongo|db\.cursor).*",
        "Network": r"(?i).*(requests\.|urllib\.|http\.|socket\.|aiohttp\.|httpx\.|paramiko\.).*",
        "Command Execution": r"(?i).*(subprocess\.|os\.system|os\.popen|os\.spawn|shlex\.|pty\.).*",
        "Code Execution": r"(?i).*(\beval\b|\bexec\b|load_string|run_code|InteractiveInterpreter|compile\(|pickle\.|marshal\.).*",
        "Cryptography": r"(?i).*(hashlib|Crypto|cryptography\.|hmac\.|secrets\.|JwtSecurityToken|base64\.b64encode).*",
    },
    "java": {
        "File System": r"(?i).*(java\.io\.(File|FileInputStream|FileOutputStream|FileReader|FileWriter|RandomAccessFile)|java\.nio\.file\.Files\.(write|read|delete|create|move|copy)|DocumentBuilder|SAXParser|XMLReader|Transformer|org\.apache\.commons\.io).*",
        "Database": r"(?i).*(execute|query|sql|mongo|redis|jdbc|hibernate|jpa|mybatis|crudrepository|Jdbi).*",
        "Network": r"(?i).*(java\.net\.(Http|Socket|URL)|javax\.net\.|jsoup|okhttp|apache\.http|HttpClient|WebClient|RestTemplate|FeignClient|spring-cloud-starter-openfeign).*",
        "Command Execution": r"(?i).*(ProcessBuilder|Runtime\.exec|os\.popen).*",
        "Code Execution": r"(?i).*(eval\b|exec\b(?!uteQuery|uteUpdate)|ScriptEngine|GroovyShell|PythonInterpreter|invokedynamic|Ognl).*",
        "Cryptography": r"(?i).*(MessageDigest|Cipher|Signature|BCrypt|SCrypt|PBKDF2|javax\.crypto|jsonwebtoken|Jwts|Jwt|Base64).*",
    },
    "javascript": {
        "File System": r"(?i).*((fs[:\.]|fs/)(read|write|append|open|link|mkdir|rm|create|readdir|unlink)|path[:\.]).*",
        "Database": r"(?i).*(execute|query|sql|mongo|redis|sequelize|mongoose|knex|prisma|pg-pool|pg[:\.]|mysql|mysql2|typeorm|createQueryBuilder|([a-z0-9](Repository|Repo|Model|Context|Db)[:\.](save|update|delete|insert|remove|count|increment|decrement|find|get)(One|By|And|Many|All|Raw|AndCount)?\b)).*",
        "Network": r"(?i).*(http[:\.]|socket[:\.]|axios|node-fetch|request[:\.]|fetch\b|got[:\.]|superagent|nodemailer|([a-z0-9](Client|Http|Api)[:\.](get|post|put|delete|patch|head)\b)).*",
        "Command Execution": r"(?i).*(\bchild_process\b|\bexec\b|\bspawn\b).*",
        "Code Execution": r"(?i).*(\beval\b|vm[:\.](runInContext|runInNewContext|runInThisContext)|new Function\(|serialize-javascript).*",
        "Cryptography": r"(?i).*(crypto|bcrypt|scrypt|argon2|jsonwebtoken|\bjwt\b|\bsign\b).*",
    },
    "csharp": {
        "File System": r"(?i).*(System\.IO\.(File|Directory|StreamWriter|StreamReader)|XmlDocument|XmlSerializer|XmlReader|XDocument|XElement).*",
        "Database": r"(?i).*(execute|query|sql|System\.Data|EntityFrameworkCore|FromSql|ExecuteSqlCommand|DbSet|Where|FirstOrDefault|ToList|Any|Count).*",
        "Network": r"(?i).*(System\.Net\.(Http|Socket|WebClient)|HttpClient|RestSharp|WebRequest).*",
        "Command Execution": r"(?i).*(Diagnostics\.Process|System\.Management\.Automation).*",
        "Code Execution": r"(?i).*(\beval\b|exec\b|CSharpCompilation|Assembly\.Load|Reflection\.MethodInfo\.Invoke).*",
        "Cryptography": r"(?i).*(System\.Security\.Cryptography|BCrypt|SCrypt|JwtSecurityToken|Jwt|MD5|SHA1|SHA256|SymmetricSecurityKey|SigningCredentials|WriteToken|FromBase64String|authorizeCreateAccessToken|createAccessToken).*",
    },
}

#: Callees that a call graph leaves out unless told otherwise.
CALL_GRAPH_EXCLUDES = (
    r"java\..*", r"javax\..*", r"sun\..*", r"jdk\..*", r"org\.springframework\..*", r"posix\..*", r"nt\..*", r"_.*",
    r"typing\..*", r"abc\..*", r"genericpath\..*", r"axios\..*", r"fs\..*", r"path\..*", r"mongoose\..*",
    r"express\..*", r"express-validator\..*", r"lodash\..*", r"moment\..*", r"date-fns\..*", r"uuid\..*",
    r"react\..*", r"__ecma\..*", "Number", "String", "Boolean", "Array", "Object", "Date.*", "Promise.*",
    ".*status", ".*json", ".*next", ".*log", "debug", "info", "warn", "error", r"console\..*", "<operator>.*",
    ".*findById.*", ".*findOneAndUpdate.*", ".*findByIdAndUpdate.*", ".*findOne.*", ".*find", ".*save", ".*create",
    ".*delete.*", ".*update.*", ".*insert.*", ".*v4", ".*toLocaleLowerCase", ".*toLocaleUpperCase", ".*padStart",
    ".*basename", ".*dirname", ".*existsSync", ".*from", ".*startOfDay",
)
