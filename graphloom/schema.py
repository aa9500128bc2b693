"""Fixed values and schemas of the graph tables."""

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
OWL_THING = "<http://www.w3.org/2002/07/owl#Thing>"

TRIPLES = "line_no long, s string, p string, o string"
NODES = "node_id long, label string"
EDGES = "edge_id long, src long, dst long, pred string"
#: A record of the co-occurrence matrix, as in the binary format that embedding trainers read.
RECORD = "word1 int, word2 int, val double"
