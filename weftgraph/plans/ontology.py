"""The schema contract: node, property and relationship types, and what follows from
them without looking at data (P13, P14, G6, G7, R1, R15 to R20, R36, S28, S29, T8, X14)."""

from __future__ import annotations

import json
import re
from collections import deque
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

TYPES = ("STRING", "INTEGER", "FLOAT", "BOOLEAN", "DATETIME", "DATE", "POINT", "LIST")
CARDINALITIES = ("ONE_TO_ONE", "ONE_TO_MANY", "MANY_TO_ONE", "MANY_TO_MANY")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Property:
    type: str = "STRING"
    unique: bool = False
    index: bool = False
    required: bool = False
    aliases: tuple[str, ...] = ()
    enum: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    description: str = ""


@dataclass(frozen=True)
class NodeType:
    properties: dict[str, Property] = field(default_factory=dict)
    aliases: tuple[str, ...] = ()
    broader: tuple[str, ...] = ()
    identity: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class RelationType:
    source: str = "Any"
    target: str = "Any"
    cardinality: str = "MANY_TO_MANY"
    aliases: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Ontology:
    name: str
    version: str = "1.0.0"
    nodes: dict[str, NodeType] = field(default_factory=dict)
    relations: dict[str, RelationType] = field(default_factory=dict)

    # -- is-a

    def ancestors(self, label: str) -> set[str]:
        """The label and all that it is a kind of."""
        seen, queue = set(), deque([label])
        while queue:
            x = queue.popleft()
            if x not in seen:
                seen.add(x)
                queue.extend(self.nodes[x].broader if x in self.nodes else ())
        return seen

    def descendants(self, label: str) -> set[str]:
        return {x for x in self.nodes if label in self.ancestors(x)}

    def conforms(self, label: str, declared: str) -> bool:
        return declared == "Any" or declared in self.ancestors(label)

    # -- R1, R17: validation

    def problems(self) -> list[str]:
        out = []
        for n, t in self.nodes.items():
            if not NAME.fullmatch(n):
                out.append(f"label {n!r} has characters that are not allowed")
            if not any(p.unique for p in t.properties.values()) and not t.identity:
                out.append(f"label {n} has no unique property")
            out += [f"{n}.{k} has unknown type {p.type}" for k, p in t.properties.items() if p.type not in TYPES]
            out += [f"label {n} is a kind of unknown label {b}" for b in t.broader if b not in self.nodes]
            if any(n in self.ancestors(b) for b in t.broader):
                out.append(f"label {n} is a kind of itself")
        for r, t in self.relations.items():
            if not NAME.fullmatch(r):
                out.append(f"relationship {r!r} has characters that are not allowed")
            out += [f"relationship {r} ends at unknown label {x}" for x in (t.source, t.target) if x != "Any" and x not in self.nodes]
            if t.cardinality not in CARDINALITIES:
                out.append(f"relationship {r} has unknown cardinality {t.cardinality}")
        return out

    # -- P13, P14: repairing a question's slots

    def orient(self, anchor: str, target: str, relation: str) -> tuple[str, str, str]:
        """(anchor, target, anchor's role): labels that the declared direction
        contradicts are swapped."""
        t = self.relations.get(relation)
        if t is None:
            return anchor, target, "either"
        if self.conforms(anchor, t.source) and self.conforms(target, t.target):
            return anchor, target, "source"
        if self.conforms(anchor, t.target) and self.conforms(target, t.source):
            return anchor, target, "target"
        return target, anchor, "source"

    def match_relation(self, said: str) -> str | None:
        """The relationship that a free name means, by name, alias or shared words."""
        key = re.sub(r"[^a-z0-9]+", "_", said.lower()).strip("_")
        words = set(key.split("_"))
        best = None
        for r, t in sorted(self.relations.items()):
            names = [r.lower(), *(re.sub(r"[^a-z0-9]+", "_", a.lower()) for a in t.aliases)]
            if key in names:
                return r
            score = max(len(words & set(n.split("_"))) / max(1, len(words | set(n.split("_")))) for n in names)
            if score >= 0.5 and (best is None or score > best[0]):
                best = (score, r)
        return best[1] if best else None

    # -- G6, G7: what paths are possible

    def steps(self, types: list[str] | None = None, directed: bool = False) -> dict[str, set[tuple[str, str]]]:
        """label -> (relationship, label) that one hop may reach."""
        out: dict[str, set[tuple[str, str]]] = {n: set() for n in self.nodes}
        for r, t in self.relations.items():
            if types and r not in types:
                continue
            sources = self.nodes if t.source == "Any" else self.descendants(t.source)
            targets = self.nodes if t.target == "Any" else self.descendants(t.target)
            for s in sources:
                out[s] |= {(r, x) for x in targets}
            if not directed:
                for x in targets:
                    out[x] |= {(r, s) for s in sources}
        return out

    def reachable(self, start: str, target: str, hops: int, types: list[str] | None = None, directed: bool = False) -> bool:
        """Whether any data could have such a path: an empty answer is proved from the
        schema alone if not."""
        now, steps = {start}, self.steps(types, directed)
        for _ in range(hops):
            now = {x for n in now for _, x in steps.get(n, ())}
            if target in now:
                return True
        return False

    def connecting(self, start: str, target: str, hops: int) -> list[str]:
        """Relationship types on some path of at most ``hops`` between two labels."""
        steps = self.steps()
        near = [{start}]
        for _ in range(hops):
            near.append({x for n in near[-1] for _, x in steps.get(n, ())})
        far = [{target}]
        for _ in range(hops):
            far.append({x for n in far[-1] for _, x in steps.get(n, ())})
        ok = {r for i in range(hops) for j in range(hops - i) for n in near[i] for r, x in steps.get(n, ()) if x in far[j]}
        return sorted(ok)

    def directed_path(self, start: str, target: str, hops: int, types: list[str]) -> bool:
        """An arrow is drawn only if every type names both ends and the target lies
        downstream."""
        own = [self.relations[t] for t in types if t in self.relations]
        return len(own) == len(types) and all(t.source != "Any" and t.target != "Any" for t in own) and self.reachable(start, target, hops, types, directed=True)

    # -- tables for joins

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(ont_nodes, ont_props, ont_rels), as small as the schema."""
        n = [(k, list(v.broader), list(v.identity)) for k, v in self.nodes.items()]
        p = [(k, a, x.type, x.unique, x.required, list(x.enum), None if x.low is None else float(x.low), None if x.high is None else float(x.high)) for k, v in self.nodes.items() for a, x in v.properties.items()]
        r = [(k, v.source, v.target, v.cardinality) for k, v in self.relations.items()]
        return (
            spark.createDataFrame(n, "label string, broader array<string>, identity array<string>"),
            spark.createDataFrame(p, "label string, prop string, type string, unique boolean, required boolean, enum array<string>, low double, high double"),
            spark.createDataFrame(r, "type string, source string, target string, cardinality string"),
        )

    def isa(self, spark: SparkSession) -> DataFrame:
        """(label, ancestor), each label its own ancestor."""
        return spark.createDataFrame([(n, a) for n in self.nodes for a in sorted(self.ancestors(n))], "label string, ancestor string")

    # -- R15, R16, T8: versions

    def atoms(self) -> dict[str, str]:
        out = {f"label {n}": "" for n in self.nodes}
        out |= {f"property {n}.{k}": f"{p.type}{' required' if p.required else ''}" for n, t in self.nodes.items() for k, p in t.properties.items()}
        return out | {f"relationship {r}": f"{t.source}->{t.target} {t.cardinality}" for r, t in self.relations.items()}

    def merge(self, other: Ontology) -> Ontology:
        """Union; the other's definitions complete, but do not replace, one's own."""
        nodes = dict(self.nodes)
        for n, t in other.nodes.items():
            nodes[n] = replace(nodes[n], properties=t.properties | nodes[n].properties) if n in nodes else t
        return replace(self, nodes=nodes, relations=other.relations | self.relations)

    def subtract(self, other: Ontology) -> Ontology:
        nodes = {n: t for n, t in self.nodes.items() if n not in other.nodes}
        return replace(self, nodes=nodes, relations={r: t for r, t in self.relations.items() if r not in other.relations and all(x == "Any" or x in nodes for x in (t.source, t.target))})

    # -- S28, S29: exchange

    def document(self) -> dict:
        """The ontology as plain lists and maps, without what is empty."""
        said = lambda x: {k: list(v) if isinstance(v, tuple) else v for k, v in vars(x).items() if k != "properties" and v not in (False, (), None, "")}
        node = lambda t: {"properties": {k: said(p) for k, p in t.properties.items()}, **said(t)}
        return {"name": self.name, "version": self.version, "nodes": {n: node(t) for n, t in self.nodes.items()}, "relations": {r: said(t) for r, t in self.relations.items()}}

    @staticmethod
    def from_document(d: dict) -> Ontology:
        tup = lambda x: {k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}
        node = lambda t: NodeType({k: Property(**tup(p)) for k, p in (t.get("properties") or {}).items()}, **tup({k: v for k, v in t.items() if k != "properties"}))
        return Ontology(d["name"], str(d.get("version", "1.0.0")), {n: node(t) for n, t in d["nodes"].items()}, {r: RelationType(**tup(t)) for r, t in (d.get("relations") or {}).items()})

    def to_json(self) -> str:
        return json.dumps(self.document(), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Ontology:
        return Ontology.from_document(json.loads(text))

    def to_yaml(self) -> str:
        """Block style: a map an indented line a key, lists and scalars as JSON, which is
        YAML's own flow style."""

        def lines(x: dict, depth: int) -> list[str]:
            out = []
            for k, v in x.items():
                nested = isinstance(v, dict) and v
                out += [f"{'  ' * depth}{json.dumps(k) if not NAME.fullmatch(k) else k}:{'' if nested else ' ' + json.dumps(v, ensure_ascii=False)}"]
                out += lines(v, depth + 1) if nested else []
            return out

        return "\n".join(lines(self.document(), 0)) + "\n"

    @staticmethod
    def from_yaml(text: str) -> Ontology:
        """What ``to_yaml`` writes, and hand-written block maps of plain scalars."""
        root: dict = {}
        open_: list[tuple[int, dict]] = [(-1, root)]
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            m = re.fullmatch(r'(\s*)("(?:[^"\\]|\\.)*"|[^\s:#][^:]*?)\s*:(?:\s+(.*?))?\s*', line)
            if not m:
                raise ValueError(f"no key and value: {line!r}")
            depth, key, said = len(m[1]), json.loads(m[2]) if m[2].startswith('"') else m[2], m[3]
            while open_[-1][0] >= depth:
                open_.pop()
            if said in (None, ""):
                open_[-1][1][key] = {}
                open_.append((depth, open_[-1][1][key]))
                continue
            try:
                open_[-1][1][key] = json.loads(said)
            except ValueError:
                open_[-1][1][key] = said.strip("'")
        return Ontology.from_document(root)

    def to_jsonld(self, base: str = "urn:weft:") -> str:
        """Linked JSON: labels are OWL classes, properties and relationships those of OWL;
        the document itself rides along, so nothing is lost."""
        context = {"@vocab": base, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "skos": "http://www.w3.org/2004/02/skos/core#"}
        ref = lambda n: {"@id": f"{base}{n}"}
        graph = []
        for n, t in self.nodes.items():
            graph.append({**ref(n), "@type": "owl:Class", "rdfs:subClassOf": [ref(b) for b in t.broader], "skos:altLabel": list(t.aliases), "rdfs:comment": t.description})
            graph += [{**ref(f"{n}.{k}"), "@type": "owl:DatatypeProperty", "rdfs:domain": ref(n), "type": p.type} for k, p in t.properties.items()]
        for r, t in self.relations.items():
            ends = {f"rdfs:{side}": ref(x) for side, x in (("domain", t.source), ("range", t.target)) if x != "Any"}
            graph.append({**ref(r), "@type": "owl:ObjectProperty", **ends})
        return json.dumps({"@context": context, "@id": f"{base}{self.name}", "@graph": graph, "document": self.document()}, sort_keys=True)

    @staticmethod
    def from_jsonld(text: str) -> Ontology:
        return Ontology.from_document(json.loads(text)["document"])

    def to_turtle(self, base: str = "urn:weft:") -> str:
        out = [f"@prefix : <{base}> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", "@prefix owl: <http://www.w3.org/2002/07/owl#> ."]
        for n, t in sorted(self.nodes.items()):
            out.append(f":{n} a owl:Class" + "".join(f" ; rdfs:subClassOf :{b}" for b in t.broader) + " .")
            out += [f":{n}_{k} a owl:DatatypeProperty ; rdfs:domain :{n} ." for k in sorted(t.properties)]
        for r, t in sorted(self.relations.items()):
            out.append(f":{r} a owl:ObjectProperty" + (f" ; rdfs:domain :{t.source}" if t.source != "Any" else "") + (f" ; rdfs:range :{t.target}" if t.target != "Any" else "") + " .")
        return "\n".join(out) + "\n"

    def to_shacl(self, base: str = "urn:weft:") -> str:
        kind = {"INTEGER": "xsd:integer", "FLOAT": "xsd:double", "BOOLEAN": "xsd:boolean", "DATE": "xsd:date", "DATETIME": "xsd:dateTime"}
        out = [f"@prefix : <{base}> .", "@prefix sh: <http://www.w3.org/ns/shacl#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> ."]
        for n, t in sorted(self.nodes.items()):
            shapes = []
            for k, p in sorted(t.properties.items()):
                own = [f"sh:path :{k}", f"sh:datatype {kind.get(p.type, 'xsd:string')}"] + (["sh:minCount 1"] if p.required else [])
                own += [f"sh:in ({' '.join(json.dumps(e) for e in p.enum)})"] if p.enum else []
                own += [f"sh:minInclusive {p.low}"] if p.low is not None else []
                own += [f"sh:maxInclusive {p.high}"] if p.high is not None else []
                shapes.append(f" ; sh:property [ {' ; '.join(own)} ]")
            out.append(f":{n}Shape a sh:NodeShape ; sh:targetClass :{n}" + "".join(shapes) + " .")
        return "\n".join(out) + "\n"


def classify_change(old: Ontology, new: Ontology) -> list[tuple[str, str]]:
    """(atom, BACKWARD | FORWARD | BREAKING) of every difference: what is added is read
    by old readers unless it is required; what goes or changes breaks them."""
    a, b = old.atoms(), new.atoms()
    out = [(k, "FORWARD" if v.endswith("required") else "BACKWARD") for k, v in b.items() if k not in a]
    out += [(k, "BREAKING") for k in a if k not in b]
    out += [(k, "BACKWARD" if a[k] == b[k] + " required" else "BREAKING") for k in a if k in b and a[k] != b[k]]
    return sorted(out)


def recommended_bump(changes: list[tuple[str, str]]) -> str:
    kinds = {k for _, k in changes}
    return "major" if "BREAKING" in kinds else "minor" if kinds else "patch"


def richness(o: Ontology) -> dict[str, float]:
    """Inheritance, attribute and relationship richness of a schema."""
    n, isa, rel = len(o.nodes), sum(len(t.broader) for t in o.nodes.values()), len(o.relations)
    return {"inheritance": isa / n if n else 0.0, "attribute": sum(len(t.properties) for t in o.nodes.values()) / n if n else 0.0, "relationship": rel / (rel + isa) if rel + isa else 0.0}


def mean_distance(o: Ontology) -> float | None:
    """Mean shortest distance of label pairs that are connected."""
    total = pairs = 0
    steps = o.steps()
    for s in o.nodes:
        seen, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for _, y in steps[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
        total, pairs = total + sum(seen.values()), pairs + len(seen) - 1
    return total / pairs if pairs else None


def clean_taxonomy(o: Ontology, rigid: dict[str, bool], identity: dict[str, bool]) -> list[str]:
    """A rigid type may not be a kind of an anti-rigid one, nor one without
    identity a kind of one that carries it."""
    out = []
    for n, t in sorted(o.nodes.items()):
        for b in t.broader:
            if rigid.get(n) is True and rigid.get(b) is False:
                out.append(f"{n} is rigid but a kind of anti-rigid {b}")
            if identity.get(n) is False and identity.get(b) is True:
                out.append(f"{n} carries no identity but is a kind of {b}, which does")
    return out


def context_slice(o: Ontology, question: str) -> set[str]:
    """Labels that the question's words of three letters up name, with their
    neighbours."""
    words = {w for w in re.findall(r"[a-z0-9]{3,}", question.lower())}
    hit = {n for n, t in o.nodes.items() if any(w in n.lower() or any(w in a.lower() for a in t.aliases) for w in words)}
    return hit | {x for n in hit for _, x in o.steps()[n]}


#: The schema of the demo graph.
DEMO = Ontology(
    "trade",
    nodes={
        "Party": NodeType({"name": Property(unique=True)}),
        "Customer": NodeType({"id": Property("INTEGER", unique=True), "name": Property(required=True, index=True), "balance": Property("FLOAT", low=-1000.0, high=10000.0), "segment": Property(enum=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))}, broader=("Party",)),
        "Supplier": NodeType({"id": Property("INTEGER", unique=True), "name": Property(required=True)}, broader=("Party",)),
        "Part": NodeType({"id": Property("INTEGER", unique=True), "name": Property(required=True), "size": Property("INTEGER", low=1, high=40)}),
        "Nation": NodeType({"id": Property("INTEGER", unique=True), "name": Property()}),
        "Region": NodeType({"id": Property("INTEGER", unique=True), "name": Property()}),
    },
    relations={
        "TRANSFER": RelationType("Customer", "Supplier"),
        "LOCATED_IN": RelationType("Party", "Nation", "MANY_TO_ONE", aliases=("based in",)),
        "IN_REGION": RelationType("Nation", "Region", "MANY_TO_ONE"),
    },
)
