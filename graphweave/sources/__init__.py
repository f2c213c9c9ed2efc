"""Reading files, workspaces, TypeScript sources and graphs; writing graphs."""
