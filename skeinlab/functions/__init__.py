"""skeinlab.functions"""
