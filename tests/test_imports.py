"""Import resolution of every language on a small tree."""

import pytest

from skein.operators import imports

FILES = (
    "com/example/Foo.java com/example/Bar.java lib/com/example/Foo.kt lib/com/example/X.kts s/coll/mutable/A.scala app/Models/User.cs pkg/os/path.py os/path/__init__.py os/path/x.py pkg/mod/a.py pkg/mod/__init__.py "
    "src/Http/Kernel.php src/Http/Kernel/Sub.php k8s/vendor/github.com/a/b/core/v1/types.go core/v1/doc.go errors/e.go main.go include/animal.h src/animal.h src/zoo/lion.h Sources/Zoo/Lion.swift Zoo/readme.md "
    "lib/src/widget.dart app/widget.dart lib/animal.rb other/animal.rb web/src/util.ts web/src/util/index.ts web/src/view/index.tsx web/lib/core.js crate/src/lib.rs crate/src/net/mod.rs crate/src/net/tcp.rs crate/src/io.rs"
).split()

CASES = [
    ("java", "import:com.example.Foo", "a/B.java", {"com/example/Foo.java": {"class"}}),
    ("java", "import:com.example.*", "a/B.java", {"com/example/Foo.java": {"package"}, "com/example/Bar.java": {"package"}, "lib/com/example/Foo.kt": {"package"}, "lib/com/example/X.kts": {"package"}}),
    ("kotlin", "com.example.X", "a.kt", {"lib/com/example/X.kts": {"class"}}),
    ("scala", "coll.mutable.A", "a.scala", {"s/coll/mutable/A.scala": {"class"}}),
    ("c#", "Models.User", "a.cs", {"app/Models/User.cs": {"class"}}),
    ("python", "os.path", "m.py", {"pkg/os/path.py": {"module"}, "os/path/__init__.py": {"package", "folder"}, "os/path/x.py": {"folder"}}),
    ("python", ".a", "pkg/mod/b.py", {"pkg/mod/a.py": {"relative module"}}),
    ("python", "..mod", "pkg/mod/b.py", {"pkg/mod/__init__.py": {"relative package"}}),
    ("python", "....mod", "pkg/mod/b.py", {}),
    ("php", "Http\\Kernel", "i.php", {"src/Http/Kernel.php": {"class"}, "src/Http/Kernel/Sub.php": {"namespace"}}),
    ("go", "github.com/a/b/core/v1", "x/y.go", {"k8s/vendor/github.com/a/b/core/v1/types.go": {"vendored module"}, "core/v1/doc.go": {"module folder"}}),
    ("go", "errors", "x/y.go", {"errors/e.go": {"module folder"}}),
    ("cpp", '"animal.h"', "src/main.cc", {"src/animal.h": {"include"}}),
    ("objc", '"../animal.h"', "src/zoo/a.m", {"src/animal.h": {"include"}}),
    ("c", "<animal.h>", "src/main.c", {}),
    ("c", '"../../../animal.h"', "src/main.c", {}),
    ("swift", "Zoo", "a.swift", {"Sources/Zoo/Lion.swift": {"module"}}),
    ("dart", "package:app/src/widget.dart", "a.dart", {"lib/src/widget.dart": {"library"}}),
    ("dart", "dart:io", "a.dart", {}),
    ("dart", "./widget.dart", "app/a.dart", {}),
    ("ruby", "animal", "lib/zoo.rb", {"lib/animal.rb": {"relative"}}),
    ("ruby", "../other/animal.rb", "lib/zoo.rb", {"other/animal.rb": {"relative"}}),
    ("ruby", "gem:animal", "lib/zoo.rb", {}),
    ("typescript", "./util", "web/src/a.ts", {"web/src/util.ts": {"relative"}}),
    ("typescript", "../view", "web/src/x/a.ts", {"web/src/view/index.tsx": {"relative"}}),
    ("javascript", "@lib/core", "web/src/a.ts", {"web/lib/core.js": {"relative"}}),
    ("typescript", "@lib/sub/util", "web/src/a.ts", {"web/src/util.ts": {"relative"}}),
    ("typescript", "react", "web/src/a.ts", {}),
    ("rust", "crate::net::tcp::Socket", "crate/src/io.rs", {"crate/src/net/tcp.rs": {"module"}}),
    ("rust", "super::io", "crate/src/net/mod.rs", {"crate/src/io.rs": {"module"}}),
    ("rust", "self::tcp", "crate/src/net/mod.rs", {"crate/src/net/tcp.rs": {"module"}}),
    ("rust", "super::tcp", "crate/src/net/udp.rs", {"crate/src/net/tcp.rs": {"module"}}),
    ("cobol", "x", "a", {}),
    (None, "com.example.Foo", "a", {}),
    ("java", None, "a", {}),
    ("ruby", "animal", None, {}),
]


def test_all_languages_in_one_plan(spark):
    files = spark.createDataFrame([*enumerate(FILES), (99, None)], "file_id long, path string")
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "import_id long, language string, spec string, path string")
    aliases = spark.createDataFrame([("@lib", "web/lib"), ("@lib/sub", "web/src/")], "prefix string, folder string")
    got = {i: {} for i in range(len(CASES))}
    for r in imports.resolve(rows, files, aliases).collect():
        got[r["import_id"]].setdefault(r["target"], set()).add(r["rule"])
    for i, c in enumerate(CASES):
        assert got[i] == c[3], c
    plan = imports.resolve(rows, files, aliases)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
