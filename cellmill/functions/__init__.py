"""cellmill.functions"""
