"""Graph, walk, embedding, feature and evaluation operators."""
