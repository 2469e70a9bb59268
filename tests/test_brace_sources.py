import pytest

from tessera.sources import java_source as J
from tessera.sources import typescript_source as T

TS = '''
import * as cp from "child_process";
import { exec, spawn as sp } from 'node:child_process';
import Core from "./core";
const vm = require("vm");
const { execSync } = require('child_process');
// eval("comment") cp.exec("x")
export abstract class Store<T> extends Core<T> implements Disposable, Other { run() { return "class X {}"; } }
@Component({selector: 'a'})
export class View extends Base { }
export interface Plugin { load(): void }
class Private {}
export function register(name: string, opts?: {a: number}) { cp.exec(name); }
cp.spawn("ls", []);
exec("ls");
execSync("ls");
vm.runInNewContext(code);
eval(code);
new Function("a", code);
require(name);
require("fixed");
setTimeout("alert(1)", 5);
setTimeout(() => 1, 5);
model.eval(x); other.exec("no"); re.exec(s);
'''
JS = '''
class Command {}
class Help {}
class Internal {}
function makeOption() {}
exports.Command = Command;
module.exports.Help = Help;
exports.makeOption = makeOption;
'''
JAVA = '''
package a.b;
import java.util.List;
import static java.lang.Math.*;
/** class Fake {} */
@Plugin(name = "x")
public abstract class Exporter<T> extends base.Core<T> implements Hook, x.Other<T> {
  private ScriptEngine engine;
  class Inner {}
  void go(String c) throws Exception {
    engine.eval(c);
    ObjectInputStream in = new ObjectInputStream(s);
    Object o = in.readObject();
    Runtime.getRuntime().exec("sh");
    ProcessBuilder pb = new ProcessBuilder("bash", "-c", c);
    pb.start();
    Class.forName(c);
    this.list.eval(c); map.readObject(); new Plain(c);
  }
  private void readObject(ObjectInputStream in) { }
  private void readObject(String other) { }
}
interface Quiet { }
public record Pair(int a, int b) implements Hook { }
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("brace")
    (root / "src").mkdir()
    for name, text in {"src/app.ts": TS, "src/app.d.ts": "export class Command {}", "lib.js": JS, "src/Exporter.java": JAVA}.items():
        (root / name).write_text(text, encoding="utf-8")
    return str(root)


def test_typescript_declarations(spark, tree):
    m = {r.path: r for r in T.modules(spark, tree).collect()}
    assert set(m) == {"src/app.ts", "lib.js"} and m["src/app.ts"].qualname == "src/app"
    d = {x.name: x for x in m["src/app.ts"].declarations}
    assert set(d) == {"Store", "View", "Plugin", "Private", "register"}
    assert d["Store"].is_abstract and d["Store"].is_public and d["Store"].bases == ["Core<T>", "Disposable", "Other"]
    assert d["View"].decorators == ["Component"] and not d["View"].is_abstract and d["Plugin"].is_abstract and not d["Private"].is_public
    assert d["register"].args == ["name", "opts?"]
    assert {x.name: x.is_public for x in m["lib.js"].declarations} == {"Command": True, "Help": True, "Internal": False, "makeOption": True}


def test_typescript_audit(spark, tree):
    got = sorted((r.id, r.call) for r in T.audit(T.modules(spark, tree).cache()).collect())
    assert got == sorted([("TSX-CHILD", "cp.exec"), ("TSX-CHILDDIRECT", "cp.spawn"), ("TSX-CHILD", "exec"), ("TSX-CHILD", "execSync"), ("TSX-VM", "vm.runInNewContext"), ("TSX-EVAL", "eval"), ("TSX-JSFUNC", "Function"), ("TSX-DYNREQUIRE", "require"), ("TSX-TIMERSTR", "setTimeout")])


def test_java_declarations(spark, tree):
    m = J.modules(spark, tree).first()
    d = {x.name: x for x in m.declarations}
    assert set(d) == {"Exporter", "Quiet", "Pair"} and m.imports == ["java.util.List", "java.lang.Math.*"]
    assert d["Exporter"].bases == ["Core", "Hook", "Other"] and d["Exporter"].decorators == ["Plugin"] and d["Exporter"].is_abstract and d["Exporter"].is_public
    assert not d["Quiet"].is_public and d["Quiet"].is_abstract and d["Pair"].bases == ["Hook"]


def test_java_audit(spark, tree):
    got = sorted((r.id, r.severity, r.lineno) for r in J.audit(J.modules(spark, tree).cache()).collect())
    assert got == sorted([("TSX-SCRIPT", "high", 11), ("TSX-JDESER", "high", 13), ("TSX-JEXEC", "high", 14), ("TSX-JEXEC", "high", 15), ("TSX-JEXEC", "medium", 16), ("TSX-DYNIMPORT", "medium", 17), ("TSX-JDESERHOOK", "medium", 20)])
