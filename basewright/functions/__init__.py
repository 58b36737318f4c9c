"""Status names, colours and their precedence."""
