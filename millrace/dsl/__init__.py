"""The tuple-row card language and its component-tree form."""
