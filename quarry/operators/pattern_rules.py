"""The pattern rules and flows. Ids, severities and what each looks for are fixed values."""

from __future__ import annotations

from quarry.operators.dataflow import Flow
from quarry.operators.patterns import Rule

CAUGHT = "try:\n    ...\nexcept $EXC as $E:\n    ..."
FUNCTIONS = ("def $DEF(...):\n    ...", "async def $DEF(...):\n    ...")
BUILT = ('"..." % $ARGS', '"...".format(...)', 'f"...{$X}..."', '"..." + $X', '$X + "..."')
#: Shared name lists of the rules below.
SECRET = r"(?i)^[\w.]*(password|passwd|secret|api_?key|token|signature|otp|digest)$"
LOGGED = r"(?i)^[\w.\[\]'\"]*(password|passwd|secret|api_?key|access_?token|refresh_?token|auth_?token|private_?key|bearer|credentials?)[\]'\"]*$"
LEVELS = "^(debug|info|warning|warn|error|exception|critical|log)$"
BROAD = tuple(f"try:\n    ...\nexcept{kind}:\n    {what}" for kind in ("", " Exception", " Exception as $E", " BaseException") for what in ("pass", "continue", "return $DEFAULT"))

RULES: list[Rule] = [
    Rule("python-sqlalchemy-text-built-query", "ERROR", tuple(f"text({b})" for b in BUILT[:4]) + ('sqlalchemy.text(f"...{$X}...")',)),
    Rule("python-subprocess-shell-true", "ERROR", ("subprocess.$FN($CMD, ..., shell=True, ...)",), ('subprocess.$FN("...", ..., shell=True, ...)',), where={"FN": "^(run|call|check_call|check_output|Popen|getoutput|getstatusoutput)$"}),
    Rule("python-os-system-non-literal", "ERROR", ("os.system($CMD)", "os.popen($CMD, ...)"), ('os.system("...")', 'os.popen("...", ...)')),
    Rule("python-eval-exec-non-literal", "ERROR", ("eval($X, ...)", "exec($X, ...)"), ('eval("...", ...)', 'exec("...", ...)')),
    Rule("python-ssti-render-template-string", "ERROR", ("render_template_string($T, ...)", "flask.render_template_string($T, ...)", "jinja2.Template($T, ...).render(...)"), ('render_template_string("...", ...)', 'flask.render_template_string("...", ...)', 'jinja2.Template("...", ...).render(...)')),
    Rule(
        "python-unsafe-deserialization", "ERROR", ("pickle.loads(...)", "pickle.load(...)", "cPickle.loads(...)", "marshal.loads(...)", "shelve.open(...)", "dill.loads(...)", "yaml.load(...)", "yaml.unsafe_load(...)"),
        ("yaml.load(..., Loader=yaml.SafeLoader, ...)", "yaml.load(..., Loader=yaml.CSafeLoader, ...)", "yaml.load(..., Loader=SafeLoader, ...)"),
    ),
    Rule("python-jinja2-autoescape-disabled", "ERROR", ("jinja2.Environment(..., autoescape=False, ...)", "Environment(..., autoescape=False, ...)", "aiohttp_jinja2.setup(..., autoescape=False, ...)", "$TEMPLATES.env.autoescape = False")),
    Rule("python-markupsafe-markup-non-literal", "WARNING", ("Markup($X)", "markupsafe.Markup($X)"), ('Markup("...")', 'markupsafe.Markup("...")')),
    Rule("python-weak-hash", "WARNING", ("hashlib.md5(...)", "hashlib.sha1(...)", "md5(...)", "sha1(...)", 'hashlib.new("md5", ...)', 'hashlib.new("sha1", ...)'), ("hashlib.md5(..., usedforsecurity=False, ...)", "hashlib.sha1(..., usedforsecurity=False, ...)")),
    Rule("python-insecure-random-for-secrets", "WARNING", ("$VAR = random.$FN(...)",), where={"VAR": "(?i).*(token|secret|password|passwd|otp|nonce|salt|session|api_?key).*"}),
    Rule("python-tls-verification-disabled", "ERROR", ("requests.$M(..., verify=False, ...)", "httpx.$M(..., verify=False, ...)", "ssl._create_unverified_context(...)", "aiohttp.TCPConnector(..., ssl=False, ...)")),
    Rule("python-jwt-verification-disabled", "ERROR", ('jwt.decode(..., options={..., "verify_signature": False, ...}, ...)', "jwt.decode(..., verify=False, ...)")),
    Rule("python-debug-enabled", "WARNING", ("$APP.run(..., debug=True, ...)", "aiohttp.web.Application(..., debug=True, ...)", "Application(..., debug=True, ...)", "FastAPI(..., debug=True, ...)", "uvicorn.run(..., reload=True, ...)", "DEBUG = True")),
    Rule("python-cors-wildcard-with-credentials", "ERROR", ('$APP.add_middleware(CORSMiddleware, ..., allow_origins=["*"], allow_credentials=True, ...)', "CORS($APP, ..., supports_credentials=True, ...)")),
    Rule(
        "python-hardcoded-secret", "WARNING", ('$VAR = "$VALUE"', '$FN(..., $VAR="$VALUE", ...)'),
        where={"VAR": "(?i)^[a-z_]*(password|passwd|secret|secret_key|api_key|apikey|access_token|auth_token|private_key)$", "VALUE": r"^(?!(?i:changeme|change-me|xxx+|\*+|example|dummy|test|placeholder|your[-_].*|<.*>|\$\{.*\})$).{8,}$"},
    ),
    Rule("python-tempfile-mktemp", "WARNING", ("tempfile.mktemp(...)",)),
    Rule("python-xml-external-entities", "WARNING", ("xml.etree.ElementTree.parse(...)", "xml.etree.ElementTree.fromstring(...)", "ET.parse(...)", "ET.fromstring(...)", "xml.dom.minidom.parseString(...)", "xml.sax.parseString(...)")),
    Rule(
        "python-exception-text-returned-to-client", "WARNING",
        ("HTTPException(..., detail=str($E), ...)", 'HTTPException(..., detail=f"...{$E}...", ...)', "JSONResponse(..., content={..., $K: str($E), ...}, ...)", "return {..., $K: str($E), ...}", "$MODEL(..., error=str($E), ...)", "$MODEL(..., detail=str($E), ...)"), inside=(CAUGHT,),
    ),
    Rule("python-http-request-without-timeout", "WARNING", ("requests.$M(...)", "httpx.$M(...)"), ("requests.$M(..., timeout=$T, ...)", "httpx.$M(..., timeout=$T, ...)"), where={"M": "^(get|post|put|patch|delete|head|request)$"}),
    Rule("python-blocking-call-in-async-def", "WARNING", ("time.sleep(...)", "requests.$M(...)", "subprocess.run(...)", "subprocess.check_output(...)", "subprocess.call(...)"), inside=FUNCTIONS[1:], outside=FUNCTIONS[:1]),
    Rule("python-technology-disclosure-header", "INFO", ('$R.headers["$H"] = $V', '$R.headers.__setitem__("$H", $V)', '$F(..., headers={..., "$H": $V, ...}, ...)'), where={"H": "(?i)^(x-powered-by|server|x-aspnet-version|x-aspnetmvc-version|x-runtime|x-version)$"}),
    Rule("python-static-files-mount", "WARNING", ("$APP.mount($PATH, StaticFiles(...), ...)",)),
    Rule("python-insecure-secret-default", "ERROR", ('os.getenv("$KEY", "$DEFAULT")', 'os.environ.get("$KEY", "$DEFAULT")'), where={"KEY": "(?i).*(secret|password|passwd|api_key|apikey|token|private_key|signing_key).*", "DEFAULT": ".+"}),
    Rule("python-streamlit-unsafe-html", "WARNING", ("$ST.$FN(..., unsafe_allow_html=True, ...)",)),
    Rule("python-spreadsheet-export", "INFO", ("$DF.to_excel(...)", "$DF.to_csv(...)", "csv.writer(...)", "csv.DictWriter(...)", "openpyxl.Workbook(...)", "xlsxwriter.Workbook(...)")),
    Rule("python-content-disposition-header", "INFO", ('$MSG.add_header("Content-Disposition", ...)', "FileResponse(..., filename=$NAME, ...)", '$H["Content-Disposition"] = $V', 'Response(..., headers={..., "Content-Disposition": $V, ...}, ...)')),
    Rule(
        "python-mass-assignment", "WARNING",
        ("for $K, $V in $IN.items():\n    ...\n    setattr($OBJ, $K, $V)", "$OBJ.__dict__.update($IN.$D(...))", "$MODEL(**$IN.dict(...))", "$MODEL(**$IN.model_dump(...))", "$MODEL(**await $REQ.json())", "$MODEL(**$REQ.json)", "$MODEL(**$REQ.get_json(...))", "$MODEL.objects.create(**$REQ.data)"),
    ),
    Rule(
        "python-open-redirect", "WARNING",
        ("RedirectResponse($REQ.query_params.get(...), ...)", "RedirectResponse(url=$REQ.query_params.get(...), ...)", "redirect($REQ.args.get(...), ...)", "redirect($REQ.args[$I], ...)", "redirect($REQ.GET.get(...), ...)", 'redirect($REQ.headers.get("Referer"), ...)', "HttpResponseRedirect($REQ.GET.get(...), ...)"),
    ),
    Rule("python-assert-as-guard", "WARNING", ("assert $COND",), where={"COND": "(?i).*(user|owner|role|admin|permission|auth|token|tenant|is_staff|is_superuser|allowed).*"}),
    Rule("python-cookie-missing-flags", "WARNING", ("$RESP.set_cookie(...)",), ("$RESP.set_cookie(..., httponly=True, secure=True, ...)",)),
    Rule("python-jwt-decode-without-algorithms", "WARNING", ("jwt.decode($TOKEN, $KEY, ...)",), ("jwt.decode($TOKEN, $KEY, ..., algorithms=$A, ...)", "jwt.decode($TOKEN, $KEY, $ALGS, ...)", 'jwt.decode(..., options={..., "verify_signature": False, ...}, ...)')),
    Rule(
        "python-secret-compared-with-equality", "WARNING", ("$A == $B", "$A != $B"), ("$A == None", "$A != None", '$A == "..."', '$A != "..."', '"..." == $B', '"..." != $B'), outside=tuple(f"$Q.{m}(...)" for m in ("where", "filter", "filter_by", "exclude")),
        where={"A": SECRET},
    ),
    Rule("python-archive-extract-all", "WARNING", ("$T.extractall(...)", "shutil.unpack_archive(...)"), ('$T.extractall(..., filter="data", ...)', '$T.extractall(..., filter="tar", ...)')),
    Rule("python-secret-written-to-log", "WARNING", ('$LOG.$LVL(f"...{$V}...", ...)', '$LOG.$LVL("..." % $V, ...)', '$LOG.$LVL("...", ..., $V, ...)'), where={"LVL": LEVELS, "V": LOGGED}),
    Rule("python-exception-swallowed", "INFO", BROAD),
    Rule("python-module-level-db-session", "WARNING", ("$S = $FACTORY()", "$S = sqlite3.connect(...)", "$S = psycopg2.connect(...)", "$S = pymysql.connect(...)", "$S = Session($ENGINE)"), outside=(*FUNCTIONS, "class $C:\n    ..."), where={"S": "(?i)^(db|session|db_session|conn|connection|cursor|cur)$"}),
    Rule("python-float-for-money", "INFO", ("$X = float(...)", "$X: float = $V", "$X: float"), where={"X": r"(?i)^(\w+_)?(price|amount|balance|total|cost|fee|salary|payment|refund|subtotal|tax|discount|invoice_total)$"}),
]

FLOWS: list[Flow] = [
    Flow("python-sql-injection-built-query", "ERROR", BUILT, ("$CUR.$EXEC($SINK, ...)",), but=('"..." + "..."',), where={"EXEC": "^(execute|executemany|executescript|exec_driver_sql|fetch|fetchrow|fetchval|raw)$"}),
    Flow(
        "python-upload-filename-path-traversal", "ERROR", ("$F.filename",),
        ("open($SINK, ...)", "os.path.join(..., $SINK, ...)", "Path(..., $SINK, ...)", "pathlib.Path(..., $SINK, ...)", "$P / $SINK", "shutil.$FN(..., $SINK, ...)", "os.rename(..., $SINK, ...)", "os.replace(..., $SINK, ...)", "aiofiles.open($SINK, ...)"),
        ("os.path.basename(...)", "secure_filename(...)", "Path(...).name", "pathlib.Path(...).name", "uuid.uuid4()"),
    ),
]
