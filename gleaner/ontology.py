"""Types of entities and relations that extraction may use."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from .models import Completer, json_from, parsed


def type_name(raw: str) -> str:
    """As columns.type_name; raises where nothing is left."""
    text = re.sub("_+", "_", re.sub("[^A-Z0-9_]", "", re.sub("[ -]", "_", str(raw).upper()))).strip("_")
    if not text:
        raise ValueError(f"no type name in {raw!r}")
    return text if text[0].isalpha() else f"REL_{text}"


@dataclass
class Kind:
    """A class, or with domain and range a relation."""

    name: str
    description: str = ""
    parent: str = ""
    domain: str = ""
    range: str = ""
    examples: list[str] = field(default_factory=list)


@dataclass
class Ontology:
    corpus_id: str
    classes: list[Kind] = field(default_factory=list)
    relations: list[Kind] = field(default_factory=list)
    created_at: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Ontology:
        data = json.loads(text)
        known = set(Kind.__dataclass_fields__)
        kinds = lambda key: [Kind(**{k: v for k, v in x.items() if k in known}) for x in data.get(key, [])]
        return Ontology(data["corpus_id"], kinds("classes"), kinds("relations"), data.get("created_at", ""))

    def to_turtle(self, base: str = "http://example.org/ontology/") -> str:
        quoted = lambda s: json.dumps(s, ensure_ascii=False)
        blocks = [f"@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix : <{base}> ."]
        for kinds, sort in ((self.classes, "owl:Class"), (self.relations, "owl:ObjectProperty")):
            for k in kinds:
                facts = [f"a {sort}", f"rdfs:label {quoted(k.name)}", f"rdfs:comment {quoted(k.description)}"]
                facts += [f"{p} :{v}" for p, v in (("rdfs:subClassOf", k.parent), ("rdfs:domain", k.domain), ("rdfs:range", k.range)) if v]
                blocks.append(f":{k.name} " + " ;\n    ".join(facts) + " .")
        return "\n\n".join(blocks) + "\n"

    def instructions(self) -> str:
        """What an extracting model is told."""
        classes = [f"- {c.name}{f' < {c.parent}' if c.parent else ''}: {c.description}" for c in self.classes]
        relations = [f"- {r.name} ({r.domain} to {r.range}): {r.description}" for r in self.relations]
        return "\n".join(["Use these entity types only:", *classes, "Use these relation types only:", *relations, 'Answer with JSON: {"entities": [{"name", "type", "description", "aliases"}], "relations": [{"source", "target", "type", "evidence", "confidence"}]}'])


def generated(corpus_id: str, findings: dict[str, list[dict]], completer: Completer) -> Ontology:
    """An ontology from the best findings (text, score, layer) of each strategy.

    Names that can't be made type names are left out; CONCEPT is always there.
    """
    user = "\n\n".join(f"{strategy} ({len(rows)} in all)\n" + "\n".join(f"- {r['score']:.2f}, layer {r['layer']}: {r['text'][:400]}" for r in rows[:10]) for strategy, rows in sorted(findings.items()))
    data = parsed(json_from(completer, 'Propose an ontology for these findings as JSON: {"classes": [{"name", "description", "parent", "examples"}], "relations": [{"name", "description", "domain", "range", "examples"}]}', user))
    if not isinstance(data, dict) or not data:
        raise ValueError("the answer holds no ontology")
    found: dict[str, list[Kind]] = {"classes": [], "relations": []}
    for key, kinds in found.items():
        for item in data.get(key) or []:
            try:
                name = type_name(item["name"])
            except (TypeError, KeyError, ValueError):
                continue
            ends = {} if key == "classes" else {c: item.get(c) or "CONCEPT" for c in ("domain", "range")}
            kinds.append(Kind(name, item.get("description") or "", parent=item.get("parent") or "", examples=list(item.get("examples") or []), **ends))
    if all(k.name != "CONCEPT" for k in found["classes"]):
        found["classes"].append(Kind("CONCEPT", "What no other class covers"))
    return Ontology(corpus_id, **found)
