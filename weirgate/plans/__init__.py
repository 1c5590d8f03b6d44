"""SQL models, staged transforms, and the registered queries."""
