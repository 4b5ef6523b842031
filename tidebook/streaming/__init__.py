"""The same measures on streams: stateless expressions as they are, the rest as keyed state."""
