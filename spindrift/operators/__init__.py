"""DataFrame operators: rank, resolve, fuse, link, batch and plan."""
