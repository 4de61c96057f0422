"""Framework hints: from a file's path, and from the text of a definition; the best hint of each definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import clean_path

JS, WEB = (".ts", ".js"), (".tsx", ".ts", ".jsx", ".js")
# Fixed values: (framework, multiplier, reason, one of these inside, none of these inside, one of these at the end, beginning of the file's name if one is asked), the first that fits.
PATH_RULES = (
    ("nextjs-pages", 3.0, "nextjs-page", ("/pages/",), ("/_", "/api/"), WEB),
    ("nextjs-app", 3.0, "nextjs-app-page", ("/app/",), (), ("page.tsx", "page.ts", "page.jsx", "page.js")),
    ("nextjs-api", 3.0, "nextjs-api-route", ("/pages/api/",), (), ()),
    ("nextjs-app", 2.0, "nextjs-layout", ("/app/",), ("_layout",), ("layout.tsx", "layout.ts")),
    ("expo-router", 2.0, "expo-layout", ("/app/",), (), WEB, "_layout"),
    ("expo-router", 1.5, "expo-special-route", ("/app/",), ("/+api",), WEB, "+"),
    ("expo-router", 3.0, "expo-api-route", ("/app/",), (), ("+api.ts", "+api.tsx")),
    ("expo-router", 2.5, "expo-screen", ("/app/",), (), WEB),
    ("electron", 3.0, "electron-entry", ("/src-electron/", "/electron/"), (), JS),
    ("nuxt", 3.0, "nuxt-config", (), (), ("/nuxt.config.ts", "/nuxt.config.js", "/nuxt.config.mjs")),
    ("nuxt", 3.0, "nuxt-page", ("/pages/",), (), (".vue",)),
    ("nuxt", 3.0, "nuxt-server-api", ("/server/api/",), (), JS),
    ("nuxt", 2.0, "nuxt-composable", ("/composables/", "/plugins/"), (), JS),
    ("prisma", 1.5, "prisma-schema", ("/prisma/",), (), ("schema.prisma",)),
    ("supabase", 1.5, "supabase-client", ("/lib/supabase", "/utils/supabase", "/supabase/"), (), JS),
    ("express", 2.5, "routes-folder", ("/routes/",), (), JS),
    ("mvc", 2.5, "controllers-folder", ("/controllers/",), (), JS),
    ("handlers", 2.5, "handlers-folder", ("/handlers/",), (), JS),
    ("react", 1.5, "react-component", ("/components/", "/views/"), (), (".tsx", ".jsx")),
    ("react-native", 2.5, "react-native-screen", ("/screens/", "/navigation/"), (), WEB),
    ("react-native", 2.5, "react-native-app-entry", (), (), ("/app.tsx", "/app.jsx")),
    ("sveltekit", 3.0, "sveltekit-route", ("/src/routes/",), (), (".svelte", ".ts", ".js")),
    ("svelte", 2.0, "svelte-component", (), (), (".svelte",)),
    ("astro", 3.0, "astro-page", ("/src/pages/",), (), (".astro",)),
    ("astro", 3.0, "astro-config", (), (), ("/astro.config.ts", "/astro.config.js", "/astro.config.mjs")),
    ("astro", 2.0, "astro-component", (), (), (".astro",)),
    ("django", 3.0, "django-views", (), (), ("views.py",)),
    ("django", 2.0, "django-urls", (), (), ("urls.py",)),
    ("fastapi", 2.5, "api-routers", ("/routers/", "/endpoints/", "/routes/"), (), (".py",)),
    ("python-api", 2.0, "api-folder", ("/api/",), ("__init__.py",), (".py",)),
    ("spring", 3.0, "spring-controller", ("/controller/", "/controllers/"), (), (".java",)),
    ("spring", 3.0, "spring-controller-file", (), (), ("controller.java",)),
    ("java-service", 1.8, "java-service", ("/service/", "/services/"), (), (".java",)),
    ("spring-kotlin", 3.0, "spring-kotlin-controller", ("/controller/", "/controllers/"), (), (".kt",)),
    ("spring-kotlin", 3.0, "spring-kotlin-controller-file", (), (), ("controller.kt",)),
    ("ktor", 2.5, "ktor-routes", ("/routes/",), (), (".kt",)),
    ("ktor", 2.0, "ktor-plugin", ("/plugins/",), (), (".kt",)),
    ("ktor", 2.5, "ktor-routing-file", (), (), ("routing.kt", "routes.kt")),
    ("jetpack-compose", 2.0, "compose-theme", ("/ui/theme/",), (), (".kt",)),
    ("android-kotlin", 2.5, "android-ui", ("/activity/", "/ui/"), (), (".kt",)),
    ("jetpack-compose", 2.8, "compose-activity", (), (), ("activity.kt",)),
    ("android-kotlin", 2.5, "android-component", (), (), ("fragment.kt",)),
    ("kotlin", 3.0, "kotlin-main", (), (), ("/main.kt",)),
    ("kotlin", 2.5, "kotlin-application", (), (), ("/application.kt",)),
    ("aspnet", 3.0, "aspnet-controller", ("/controllers/",), (), (".cs",)),
    ("aspnet", 3.0, "aspnet-controller-file", (), (), ("controller.cs",)),
    ("aspnet", 1.8, "aspnet-service", ("/services/", "/service/"), (), (".cs",)),
    ("aspnet", 2.5, "aspnet-middleware", ("/middleware/",), (), (".cs",)),
    ("signalr", 2.5, "signalr-hub", ("/hubs/",), (), (".cs",)),
    ("aspnet", 3.0, "aspnet-entry", (), (), ("/program.cs", "/startup.cs")),
    ("blazor", 2.5, "blazor-page", ("/pages/",), (), (".razor",)),
    ("go-http", 2.5, "go-handlers", ("/handlers/", "/handler/"), (), (".go",)),
    ("go-http", 2.5, "go-routes", ("/routes/",), (), (".go",)),
    ("go-mvc", 2.5, "go-controller", ("/controllers/",), (), (".go",)),
    ("go", 3.0, "go-main", (), (), ("/main.go",)),
    ("rust-web", 2.5, "rust-handlers", ("/handlers/", "/routes/"), (), (".rs",)),
    ("rust", 3.0, "rust-main", (), (), ("/main.rs",)),
    ("rust", 2.5, "rust-bin", ("/bin/",), (), (".rs",)),
    ("c-cpp", 3.0, "c-main", (), (), ("/main.c", "/main.cpp", "/main.cc")),
    ("c-cpp", 2.5, "c-app", ("/src/",), (), ("/app.c", "/app.cpp")),
    ("laravel", 3.0, "laravel-routes", ("/routes/",), (), (".php",)),
    ("laravel", 3.0, "laravel-controller", ("/controllers/",), (), (".php",)),
    ("laravel", 3.0, "laravel-controller-file", (), (), ("controller.php",)),
    ("laravel", 2.5, "laravel-command", ("/commands/",), (), (".php",)),
    ("laravel", 2.5, "laravel-job", ("/jobs/",), (), (".php",)),
    ("laravel", 2.5, "laravel-middleware", ("/http/middleware/",), (), (".php",)),
    ("ruby", 2.5, "ruby-executable", ("/bin/", "/exe/"), (), (".rb",)),
    ("ruby", 1.5, "ruby-rake", (), (), ("/rakefile", ".rake")),
    ("ios", 3.0, "ios-app-entry", (), (), ("/appdelegate.swift", "/scenedelegate.swift", "/app.swift")),
    ("uikit", 2.5, "uikit-viewcontroller", ("/viewcontrollers/", "/controllers/", "/screens/"), (), (".swift",)),
)
# Fixed values: (language, framework, multiplier, reason, parts of text), the first that fits.
_SCRIPT = (
    ("react", 1.8, "react-pattern", ("usestate", "useeffect", "react.fc", "createroot", "jsx-runtime")),
    ("nextjs", 2.8, "nextjs-pattern", ("getserversideprops", "getstaticprops", "nextrequest", "nextresponse", "next/navigation")),
    ("electron", 3.0, "electron-pattern", ("browserwindow", "ipcmain", "ipcrenderer", "contextbridge", "app.whenready")),
    ("react-native", 2.5, "react-native-pattern", ("react-native", "stylesheet.create", "navigationcontainer", "usenavigation", "<view")),
    ("nuxt", 2.8, "nuxt-pattern", ("definenuxtconfig", "useasyncdata", "usefetch", "nuxtpage", "definepagemeta")),
    ("nestjs", 3.2, "nestjs-decorator", ("@controller", "@get", "@post", "@put", "@delete", "@patch")),
    ("express", 2.8, "express-pattern", ("express()", "app.get", "app.post", "app.put", "app.delete", "router.get", "router.post", "router.put", "router.delete")),
)
_SPRING = ("@restcontroller", "@controller", "@getmapping", "@postmapping", "@requestmapping")
TEXT_RULES = (
    *((language, *rule) for language in ("javascript", "typescript") for rule in _SCRIPT),
    ("python", "fastapi", 3.0, "fastapi-decorator", ("@app.get", "@app.post", "@app.put", "@app.delete", "@router.get")),
    ("python", "flask", 2.8, "flask-decorator", ("@app.route", "@blueprint.route")),
    ("java", "spring", 3.2, "spring-annotation", _SPRING),
    ("kotlin", "spring-kotlin", 3.2, "spring-kotlin-annotation", _SPRING),
    ("kotlin", "ktor", 2.8, "ktor-routing", ("routing", "embeddedserver", "application.module")),
    ("csharp", "aspnet", 3.2, "aspnet-attribute", ("[apicontroller]", "[httpget]", "[httppost]", "[httpput]", "[httpdelete]", "[route]")),
    ("csharp", "efcore", 2.0, "efcore-pattern", ("dbcontext", "dbset<", "onmodelcreating")),
    ("php", "laravel", 3.0, "php-route-attribute", ("route::get", "route::post", "route::put", "route::delete", "route::resource", "#[route(")),
    ("go", "go-http", 2.5, "go-http-handler", ("http.handler", "http.handlerfunc", "servehttp", "http.responsewriter", "http.request")),
    ("go", "gin", 3.0, "gin-handler", ("gin.context", "gin.default", "gin.new")),
    ("go", "echo", 3.0, "echo-handler", ("echo.context", "echo.new")),
    ("rust", "actix-web", 3.0, "actix-attribute", ("#[get", "#[post", "#[put", "#[delete", "#[actix_web", "httprequest", "httpresponse")),
    ("rust", "axum", 3.0, "axum-routing", ("router::new", "axum::extract", "axum::routing")),
    ("swift", "uikit", 2.5, "uikit-lifecycle", ("viewdidload", "viewwillappear", "viewdidappear", "uiviewcontroller", "@ibaction")),
    ("ruby", "rails", 3.0, "rails-pattern", ("applicationcontroller", "applicationrecord", "activerecord::base", "before_action", "has_many")),
    ("dart", "flutter", 2.5, "flutter-widget", ("statelesswidget", "statefulwidget", "buildcontext", "widget build")),
)


def _hint(framework: str, multiplier: float, reason: str) -> Column:
    return F.struct(F.lit(framework).alias("framework"), F.lit(multiplier).alias("multiplier"), F.lit(reason).alias("reason"))


def _any(tests: list[Column], empty: bool) -> Column:
    out = F.lit(empty) if not tests else tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def path_hint(path: Column) -> Column:
    """struct(framework, multiplier, reason) of a path, or null."""
    p = F.concat(F.lit("/"), F.ltrim(clean_path(path), F.lit("/")))
    out = None
    for framework, multiplier, reason, inside, without, ends, *begin in PATH_RULES:
        named = F.substring_index(p, "/", -1).startswith(begin[0]) if begin else F.lit(True)
        fits = named & _any([p.contains(x) for x in inside], True) & ~_any([p.contains(x) for x in without], False) & _any([p.endswith(x) for x in ends], True)
        out = F.when(fits, _hint(framework, multiplier, reason)) if out is None else out.when(fits, _hint(framework, multiplier, reason))
    return out


def text_hint(language: Column, text: Column) -> Column:
    """struct(framework, multiplier, reason) of a definition's text (its first 600 characters), or null."""
    t, out = F.lower(F.substring(text, 1, 600)), None
    for name, framework, multiplier, reason, parts in TEXT_RULES:
        fits = (language == name) & _any([t.contains(x) for x in parts], False)
        out = F.when(fits, _hint(framework, multiplier, reason)) if out is None else out.when(fits, _hint(framework, multiplier, reason))
    return out


def best_hints(hints: DataFrame) -> DataFrame:
    """The hint with the largest multiplier of each definition (def, framework, multiplier, reason, seq), the earliest of equals."""
    return hints.groupBy("def").agg(F.max_by(F.struct("framework", "multiplier", "reason"), F.struct("multiplier", (-F.col("seq")).alias("s"))).alias("b")).select("def", "b.*")
